"""Per-workflow detail and per-repo summaries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens import rules
from forgelens.functions import text
from forgelens.functions.numeric import percentage
from forgelens.functions.ranking import numbered

PRACTICE_FLAGS = tuple(flag for flag, _, _ in rules.PRACTICES)
_FLAGS = (
    ("uses_matrix", "uses_matrix"),
    ("has_permissions_block", "has_permissions"),
    ("has_ai_review", "has_ai_review"),
    ("has_security_scan", "has_security_scan"),
    ("concurrency_set", "has_concurrency"),
    ("uses_reusable_workflows", "uses_reusable_workflows"),
)
_LISTS = ("triggers", "runs_on", "matrix_keys", "matrix_values", "reusable_workflows", "step_names", "run_commands")


def workflow_detail(workflows: DataFrame) -> DataFrame:
    """Workflow rows with nulls read as empty, empty action names dropped, and the notable actions.

    ``action_text`` is the folded text of the actions, built once for all rules that look at them.
    """
    empty = "cast(array() AS array<string>)"
    common = ", ".join(map(text.quoted, rules.COMMON_ACTIONS))
    lists = [f"coalesce({name}, {empty}) AS {name}" for name in _LISTS]
    flags = [f"coalesce({name}, false) AS {alias}" for name, alias in _FLAGS]
    base = workflows.selectExpr(
        "repo",
        "workflow_name",
        "workflow_path",
        "source_file",
        "crawl_date",
        f"coalesce(job_names, {empty}) AS jobs",
        *lists,
        f"filter(coalesce(actions_normalized, {empty}), action -> action != '') AS actions",
        *flags,
    )
    return base.withColumns(
        {
            "notable_actions": F.expr(
                f"filter(actions, action -> action NOT IN ({common}) AND NOT startswith(action, '.'))"
            ),
            "job_count": F.size("jobs").cast("bigint"),
            "action_text": text.folded_items("actions"),
        }
    ).withColumn("uses_cache", F.contains("action_text", F.lit(rules.CACHE)))


def practice_aggregates() -> dict[str, Column]:
    """Any-flags of a repo, as aggregates over its detail rows."""
    return {
        "has_matrix": F.bool_or("uses_matrix"),
        "has_permissions": F.bool_or("has_permissions"),
        "has_security_scan": F.bool_or("has_security_scan"),
        "has_ai_review": F.bool_or("has_ai_review"),
        "has_cache": F.bool_or("uses_cache"),
        "has_concurrency": F.bool_or("has_concurrency"),
        "has_reusable_workflows": F.bool_or("uses_reusable_workflows"),
    }


def practices(detail: DataFrame) -> DataFrame:
    """One row per repo: workflow count and any-flags."""
    aggregates = [column.alias(name) for name, column in practice_aggregates().items()]
    return detail.groupBy("repo").agg(F.count("*").alias("workflow_count"), *aggregates)


def repo_rollup(detail: DataFrame) -> DataFrame:
    """Practices plus the number of distinct actions, in one pass.

    Each workflow gives a row per action; position 0 (or none) stands for the workflow itself, and the any-flags
    do not mind repetition.  The distinct count is by (repo, action) first, so a large repo is spread.
    """
    aggregates = [column.alias(name) for name, column in practice_aggregates().items()]
    flags = ("uses_matrix", "has_permissions", "has_security_scan", "has_ai_review", "uses_cache", "has_concurrency", "uses_reusable_workflows")
    rows = detail.select("repo", *flags, F.posexplode_outer("actions").alias("_pos", "action"))
    return rows.groupBy("repo").agg(
        F.count_if(F.coalesce(F.col("_pos"), F.lit(0)) == 0).alias("workflow_count"),
        F.count_distinct("action").alias("action_count"),
        *aggregates,
    )


def with_maturity(repos: DataFrame) -> DataFrame:
    """Number of adopted practices and its share of all practices in whole percent."""
    score = " + ".join(f"cast({flag} AS bigint)" for flag in PRACTICE_FLAGS)
    scored = repos.withColumn("maturity_score", F.expr(score))
    pct = F.bround(F.col("maturity_score") / len(PRACTICE_FLAGS) * 100, 0).cast("bigint")
    return scored.withColumn("maturity_pct", pct)


def repo_maturity(detail: DataFrame) -> DataFrame:
    """Maturity per repo with its missing practices (both languages) in report order."""

    def missing(label: int) -> Column:
        labels = [f"CASE WHEN NOT {row[0]} THEN {text.quoted(row[label])} END" for row in rules.PRACTICES]
        return F.expr(f"array_compact(array({', '.join(labels)}))")

    scored = with_maturity(practices(detail))
    return scored.withColumns({"missing_en": missing(1), "missing_zh": missing(2)})


def missing_practices(detail: DataFrame) -> DataFrame:
    """Long form: one row per repo and missing practice."""
    return repo_maturity(detail).select("repo", F.posexplode("missing_en").alias("position", "practice"))


def repo_ranking(detail: DataFrame) -> DataFrame:
    """Repos with their place by maturity, then name."""
    scored = with_maturity(practices(detail)).select("repo", "workflow_count", "maturity_score", "maturity_pct")
    return numbered(scored, [("maturity_score", True), ("repo", False)], "position")


def notable_actions(detail: DataFrame) -> DataFrame:
    """Distinct notable actions of each repo, one per row (a repo's list has no bound)."""
    return detail.select("repo", F.explode("notable_actions").alias("action")).distinct()


def maturity_histogram(detail: DataFrame) -> DataFrame:
    scored = with_maturity(practices(detail))
    return scored.groupBy("maturity_score").agg(F.count("*").alias("repo_count")).orderBy(F.desc("maturity_score"))


def practice_adoption(detail: DataFrame) -> DataFrame:
    """Adoption of each practice; one aggregate row unpivoted, so unused practices stay."""
    counted = practices(detail).agg(
        F.count("*").alias("total"), *[F.count_if(flag).alias(flag) for flag in PRACTICE_FLAGS]
    )
    long = counted.selectExpr("total", f"stack({len(rules.PRACTICES)}, {_practice_cells()}) AS (practice, repo_count)")
    return long.select(
        "practice", "repo_count", percentage(F.col("repo_count"), F.col("total")).alias("adoption_pct")
    )


def practice_matrix(detail: DataFrame) -> DataFrame:
    """Long repo-by-practice matrix."""
    return practices(detail).selectExpr(
        "repo", f"stack({len(rules.PRACTICES)}, {_practice_cells()}) AS (practice, adopted)"
    )


def _practice_cells() -> str:
    return ", ".join(f"{text.quoted(label)}, {flag}" for flag, label, _ in rules.PRACTICES)


_TEXT_LISTS = (
    "triggers", "jobs", "actions", "notable_actions", "runs_on", "matrix_keys", "matrix_values", "step_names",
    "run_commands", "reusable_workflows",
)


def workflow_text() -> Column:
    """Text of a detail row that the practice patterns search."""
    joined = ", ".join(f"array_join({name}, ' ')" for name in _TEXT_LISTS)
    return F.expr(f"concat_ws('\\n', coalesce(workflow_name, ''), {joined})")


def workflow_items() -> Column:
    """The same text with each list item once, one per line; notable actions are among the actions."""
    lists = ", ".join(name for name in _TEXT_LISTS if name != "notable_actions")
    return F.expr(f"array_join(array_distinct(concat(array(coalesce(workflow_name, '')), {lists})), '\\n')")


def security_text() -> Column:
    """Text of a detail row that the security rules search."""
    joined = ", ".join(f"array_join({name}, ' ')" for name in ("actions", "run_commands", "step_names"))
    return F.expr(f"concat_ws(' ', coalesce(workflow_name, ''), {joined})")
