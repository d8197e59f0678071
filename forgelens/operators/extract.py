"""Workflow files to workflow rows: one distributed parse stage, everything else as expressions."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens import rules, schemas
from forgelens.functions import text
from forgelens.functions.parsers import parse_workflow_batches, read_descriptions


def parse(files: DataFrame) -> DataFrame:
    """Parse stage: raw files (repo, file_name, source_file, content) to typed rows with an ``_error`` column.

    Columns of files that parsed are never null except ``permissions``.
    """
    return files.select(*schemas.RAW_FILE.names).mapInPandas(parse_workflow_batches, schemas.PARSED)


def parse_errors(parsed: DataFrame) -> DataFrame:
    """Quarantine table: files that gave no workflow row, with the reason's kind."""
    return parsed.where(F.col("_error").isNotNull()).select(
        "repo", "file_name", "source_file", F.col("_error").alias("reason")
    )


def derive(df: DataFrame, known_ai_actions: list[str] | None = None) -> DataFrame:
    """Add the columns that follow from others and put the table in contract order."""
    df = df.withColumns(
        {
            "_uses": text.folded_items("actions_used"),
            "actions_normalized": F.transform("actions_used", text.normalized_action),
        }
    )
    df = df.withColumns(
        {
            "uses_reusable_workflows": F.size("reusable_workflows") > 0,
            "has_security_scan": text.mentions("_uses", rules.SCANNER_ACTIONS),
            "ai_review_actions": _ai_review_actions(known_ai_actions),
        }
    )
    return df.withColumn("has_ai_review", F.size("ai_review_actions") > 0).select(*schemas.WORKFLOW.names)


def _ai_review_actions(known: list[str] | None) -> Column:
    """AI-review actions of a workflow: members of a known set, or a name pattern when no set is given."""
    if known:
        return F.filter("actions_normalized", lambda action: F.array_contains(text.strings(sorted(known)), action))
    guard = text.mentions("_uses", rules.AI_ACTIONS_FALLBACK)
    return text.only_matching("actions_normalized", rules.AI_ACTIONS_FALLBACK, guard)


def workflows_from(parsed: DataFrame, crawl_date: Column, known_ai_actions: list[str] | None = None) -> DataFrame:
    """Workflow table from the parse stage."""
    good = parsed.where(F.col("_error").isNull()).withColumns(
        {
            "workflow_name": F.regexp_replace("file_name", r"(?s)(?<=.)\.[^.]*\z", ""),
            "workflow_path": F.concat(F.lit(".github/workflows/"), "file_name"),
            "crawl_date": crawl_date,
        }
    )
    return derive(good, known_ai_actions)


def with_known_ai_actions(workflows: DataFrame, known: DataFrame) -> DataFrame:
    """AI-review actions against a table of known names (column ``action``): one row per use.

    The join side has no size hint; a short list is broadcast by the planner on its own, a long one is not.
    """
    used = workflows.select("repo", "workflow_name", F.explode("actions_normalized").alias("action"))
    return used.join(known.select("action").distinct(), "action", "left_semi")


def with_known_ai_flags(workflows: DataFrame, known: DataFrame) -> DataFrame:
    """Workflows whose AI-review actions and flag come from a table of known names (column ``action``), in step order.

    The list collected for a file holds some of its own steps.
    """
    keys = ["repo", "workflow_path", "crawl_date"]
    used = workflows.select(*keys, F.posexplode("actions_normalized").alias("_pos", "action"))
    hits = used.join(known.select("action").distinct(), "action", "left_semi")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_pos", "action"))), lambda hit: hit["action"])
    found = hits.groupBy(*keys).agg(listed.alias("_found"))
    flagged = workflows.join(found, keys, "left").withColumns(
        {
            "ai_review_actions": F.coalesce("_found", text.strings(())),
            "has_ai_review": F.col("_found").isNotNull(),
        }
    )
    return flagged.select(*workflows.columns)


def action_descriptions(definitions: DataFrame) -> DataFrame:
    """Description per action from its definition files (action, candidate, content).

    ``candidate`` is the rank of the file name; the first definition with a non-empty description wins.
    """

    schema = "action string, candidate int, description string"
    remote = definitions.where(~F.col("action").startswith(".") & F.contains("action", F.lit("/")))
    parsed = remote.select("action", F.col("candidate").cast("int").alias("candidate"), "content").mapInPandas(
        read_descriptions, schema
    )
    described = F.col("description") != ""
    return parsed.groupBy("action").agg(
        F.coalesce(
            F.min_by(F.when(described, F.col("description")), F.when(described, F.col("candidate"))), F.lit("")
        ).alias("description")
    )


# --- scan of raw text without parsing -----------------------------------------
def raw_text_scan(files: DataFrame) -> DataFrame:
    """Flags and scanner names found by pattern in the whole raw text of each file."""
    content = F.col("content")
    uses = F.transform(F.regexp_extract_all(content, F.lit("(?U)" + rules.RAW_USES), F.lit(1)), text.normalized_action)
    scanned = files.withColumns({"_text": text.folded(content), "_uses": uses})
    scanners = text.mentions("_text", rules.RAW_SCANNERS)
    return scanned.select(
        "repo",
        "file_name",
        text.found(content, rules.RAW_MATRIX).alias("has_matrix"),
        content.rlike("(?m)" + rules.RAW_PERMISSIONS).alias("has_permissions"),
        text.mentions("_text", rules.RAW_AI).alias("has_ai_review"),
        text.only_matching("_uses", rules.RAW_SCANNERS, scanners).alias("security_tools"),
    )


# --- pluggable extractors ------------------------------------------------------
@dataclass(frozen=True)
class Extractor:
    """A named extractor: which files it reads and how it turns them into a table."""

    name: str
    file_glob: str
    extract: Callable[[DataFrame], DataFrame]


EXTRACTORS: dict[str, Extractor] = {}


def register(extractor: Extractor) -> Extractor:
    EXTRACTORS[extractor.name] = extractor
    return extractor


register(
    Extractor(
        "cicd",
        "*.{yml,yaml}",
        lambda files: workflows_from(parse(files), F.current_date()),
    )
)
