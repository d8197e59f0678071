"""Repository signals beyond workflows: file presence, configuration files, structure, changed files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens import rules, schemas
from forgelens.functions import configs, text
from forgelens.functions.literals import rule_table
from forgelens.functions.numeric import percentage
from forgelens.functions.parsers import parse_config_batches

SAMPLE_ENTRIES = 5


def decode_contents(files: DataFrame) -> DataFrame:
    """Base64 file bodies to text; any other encoding gives a null body and an error."""
    supported = F.col("encoding") == "base64"
    body = F.try_to_binary(F.regexp_replace("content", r"\s", ""), F.lit("base64"))
    decoded = F.when(supported, body.cast("string"))
    error = (
        F.when(F.col("content").isNull(), "missing content")
        .when(F.coalesce(~supported, F.lit(True)), F.concat(F.lit("unsupported encoding: "), F.coalesce("encoding", F.lit("none"))))
        .when(decoded.isNull(), "not base64")
    )
    return files.withColumn("error", error).withColumn("content", F.when(F.col("error").isNull(), decoded))


def workflow_files(listing: DataFrame) -> DataFrame:
    """YAML files of a listing."""
    name = F.col("path")
    return listing.where((F.col("type") == "file") & (name.endswith(".yml") | name.endswith(".yaml")))


def file_signals(files: DataFrame) -> DataFrame:
    """First present candidate path of each signal a repo has."""
    rows = [(signal, path, ordinal) for ordinal, (signal, path) in enumerate(rules.FILE_SIGNALS)]
    # as many rows as the code lists
    candidates = F.broadcast(rule_table(files.sparkSession, ("signal", "path", "ordinal"), rows))
    present = files.select("repo", "path").join(candidates, "path")
    return present.groupBy("repo", "signal").agg(F.min_by("path", "ordinal").alias("path"))


def file_signal_adoption(files: DataFrame, repos: DataFrame) -> DataFrame:
    rows = list(dict.fromkeys(signal for signal, _ in rules.FILE_SIGNALS))
    return _signal_adoption(file_signals(files), repos, rows)


def _signal_adoption(hits: DataFrame, repos: DataFrame, signals: list[str]) -> DataFrame:
    """Repos per signal and their share of all observed repos; signals nobody has stay with zeros."""
    per_repo = hits.groupBy("repo").agg(
        *[F.expr(f"bool_or(signal = {text.quoted(signal)})").alias(signal) for signal in signals]
    )
    observed = repos.select("repo").distinct().join(per_repo, "repo", "left")
    counted = observed.agg(F.count("*").alias("_total"), *[F.count_if(signal).alias(signal) for signal in signals])
    cells = ", ".join(f"{text.quoted(signal)}, {signal}" for signal in signals)
    long = counted.selectExpr("_total", f"stack({len(signals)}, {cells}) AS (signal, repo_count)")
    return long.select(
        "signal", "repo_count", percentage(F.col("repo_count"), F.col("_total")).alias("adoption_pct")
    )


# --- configuration files ------------------------------------------------------------
def config_kind(path: Column) -> Column:
    """Kind of a configuration file by its path ending; first match wins."""
    lowered = F.lower(path)
    kind = None
    for suffix, name in rules.CONFIG_KINDS:
        matches = lowered.endswith(suffix)
        kind = F.when(matches, name) if kind is None else kind.when(matches, name)
    return kind.otherwise(rules.DEFAULT_CONFIG_KIND)


def config_candidates(files: DataFrame) -> DataFrame:
    """Known configuration files with their kind."""
    known = files.where(F.col("path").isin(list(rules.CONFIG_PATHS)) & (F.col("type") == "file"))
    return known.select("repo", "path", "content", config_kind(F.col("path")).alias("kind"))


def _reader(kind: Column, path: Column) -> Column:
    """What a configuration file is read as: json, other (TOML or YAML), or none for what has no reader."""
    lowered = F.lower(path)
    ends = lambda *suffixes: lowered.rlike(r"\.(" + "|".join(suffixes) + r")$")
    # an eslint name is read as JSON whatever its ending
    linter = (
        F.when(ends("json", "jsonc") | F.contains(lowered, F.lit("biome.json")) | F.contains(lowered, F.lit("eslint")), "json")
        .when(ends("yaml", "yml", "toml"), "other")
        .otherwise("none")
    )
    return F.when(kind == "linter", linter).when(kind.isin(list(rules.JSON_CONFIG_KINDS)), "json").otherwise("other")


def config_files(files: DataFrame) -> DataFrame:
    """Configuration files of a listing, one wide row each; unreadable ones have kind ``parse_error``."""
    return read_configs(config_candidates(files))


def read_configs(known: DataFrame) -> DataFrame:
    """Rows (repo, path, content, kind) read by kind: JSON by expressions, only TOML and YAML in Python."""
    known = known.withColumn("_reader", _reader(F.col("kind"), F.col("path")))
    python = known.where("_reader = 'other'").select("repo", "path", "content", "kind")
    doc = F.when(F.col("_reader") == "json", configs.parsed(F.col("content")))
    json = known.where("_reader <> 'other'").select("repo", "path", "kind", doc.alias("_doc"))
    rows = json.select("repo", "path", *configs.row(F.col("kind"), F.col("_doc")))
    return rows.unionByName(python.mapInPandas(parse_config_batches, schemas.CONFIG))


def config_trends(configs: DataFrame, repos: DataFrame) -> DataFrame:
    """Repos per configuration kind and their share of all observed repos."""
    total = repos.select(F.count_distinct("repo").alias("n")).scalar()
    pairs = configs.where(F.col("kind") != "parse_error").select("kind", "repo").distinct()
    counted = pairs.groupBy("kind").agg(F.count("*").alias("repo_count"))
    return counted.withColumn("adoption_pct", percentage(F.col("repo_count"), total))


def config_counters(configs: DataFrame) -> DataFrame:
    return configs.agg(
        F.count_if((F.col("kind") == "tsconfig") & F.col("strict")).alias("tsconfig_strict"),
        F.count_if((F.col("kind") == "cargo") & F.col("workspace")).alias("cargo_workspaces"),
        F.count_if(F.col("kind") == "parse_error").alias("parse_errors"),
    )


def build_backends(configs: DataFrame) -> DataFrame:
    used = configs.where((F.col("kind") == "pyproject") & (F.coalesce("build_backend", F.lit("")) != ""))
    return used.groupBy("build_backend").agg(F.count("*").alias("files"))


# --- structure ------------------------------------------------------------------------
def _tool(path: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(path, F.lit(part)), tool) for part, tool in rules.STRUCTURE_TOOLS])


def structure_signals(files: DataFrame) -> DataFrame:
    """Every structure target a repo has, with the details of the file or directory."""
    # as many rows as the code lists
    targets = F.broadcast(rule_table(files.sparkSession, ("signal", "path", "type"), rules.STRUCTURE_SIGNALS))
    is_dir = F.col("type") == "dir"
    size = F.length("content").cast("bigint")
    return files.join(targets, ["path", "type"]).select(
        "repo",
        "signal",
        "path",
        "type",
        F.when(is_dir, F.size("entries").cast("bigint")).alias("entry_count"),
        F.when(is_dir, F.slice("entries", 1, SAMPLE_ENTRIES)).alias("sample_entries"),
        F.when(~is_dir, _tool(F.col("path"))).alias("tool"),
        F.when(~is_dir & (size > 0), size).alias("size"),
    )


def structure_adoption(files: DataFrame, repos: DataFrame) -> DataFrame:
    signals = list(dict.fromkeys(signal for signal, _, _ in rules.STRUCTURE_SIGNALS))
    return _signal_adoption(structure_signals(files).select("repo", "signal"), repos, signals)


# --- changed files ----------------------------------------------------------------------
def file_changes(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Outcome of each listed file against the stored content hashes; (repo, path) is unique on both sides."""
    known = state.select("repo", "path", F.col("sha").alias("_sha"))
    outcome = F.when(F.col("_sha").isNull(), "new").when(F.col("_sha") == F.col("sha"), "unchanged").otherwise("changed")
    return listing.join(known, ["repo", "path"], "left").select("repo", "path", "sha", outcome.alias("outcome"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("outcome").agg(F.count("*").alias("files"))


def updated_state(listing: DataFrame, state: DataFrame) -> DataFrame:
    """State after a run: the listed hash where there is one, else the stored one."""
    versions = state.select("repo", "path", "sha", F.lit(0).alias("_version")).unionByName(
        listing.select("repo", "path", "sha", F.lit(1).alias("_version"))
    )
    return versions.groupBy("repo", "path").agg(F.max_by("sha", "_version").alias("sha"))
