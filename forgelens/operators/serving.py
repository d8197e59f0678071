"""Read-side queries of dashboards and repo pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens.functions import text
from forgelens.functions.numeric import share
from forgelens.functions.ranking import numbered
from forgelens.operators import adoption, patterns, repos, security

DASHBOARD_PATTERNS = 8
DASHBOARD_ACTIONS = 15
DASHBOARD_SCORES = 8
ADVICE_SHOWN = 8
SORT_KEYS = ("repo", "workflow_count", "maturity_pct", "security_score", "pattern_count")


def repo_table(facts: DataFrame, scores: DataFrame) -> DataFrame:
    """Export table of repos; repos without a score count as zero."""
    joined = facts.select("repo", "workflow_count", "maturity_pct").join(scores.select("repo", "score"), "repo", "left")
    return joined.select(
        "repo", "workflow_count", "maturity_pct", F.coalesce("score", F.lit(0.0)).alias("security_score")
    )


def pattern_table(facts: DataFrame) -> DataFrame:
    """Export table of patterns."""
    return patterns.pattern_adoption(facts).select("slug", "name", "category", "repo_count", "adoption_pct")


def repo_list(
    facts: DataFrame, scores: DataFrame, query: str = "", sort: str = "security_score", descending: bool = True
) -> DataFrame:
    """Repo page list: name filter, place in the chosen order, absent values last as -1."""
    if sort not in SORT_KEYS:
        raise ValueError(f"unknown sort key: {sort}")
    listed = facts.select(
        "repo", "workflow_count", "maturity_pct", F.size(patterns.slugs_of()).cast("bigint").alias("pattern_count"),
        "has_matrix", "has_permissions", "has_ai_review", "has_security_scan", "has_cache",
    ).join(scores.select("repo", F.col("score").alias("security_score")), "repo", "left")
    wanted = query.strip().lower()
    if wanted:
        listed = listed.where(F.contains(F.lower("repo"), F.lit(wanted)))
    if sort == "repo":
        return numbered(listed, [("repo", descending)], "position")
    keyed = listed.withColumn("_key", F.coalesce(sort, F.lit(-1)))
    return numbered(keyed, [("_key", descending), ("repo", False)], "position").drop("_key")


def dashboard_patterns(facts: DataFrame) -> DataFrame:
    ranked = patterns.pattern_adoption(facts).orderBy(F.desc("repo_count"), "category", "name")
    return ranked.limit(DASHBOARD_PATTERNS).select("slug", "category", "repo_count", "adoption_pct")


def dashboard_actions(workflows: DataFrame) -> DataFrame:
    top = adoption.popular_actions(workflows, DASHBOARD_ACTIONS)
    return adoption.actions_categorized(top).select("action", "category", "usage_count")


def dashboard_security(scores: DataFrame) -> DataFrame:
    return security.top(scores, DASHBOARD_SCORES)


def pair_practices(pairs: DataFrame, practices: DataFrame) -> DataFrame:
    """Practice flags of repo pairs (left_repo, right_repo) side by side, one row per pair and practice."""
    flags = list(repos.PRACTICE_FLAGS)

    def side(name: str) -> DataFrame:
        return practices.select(
            F.col("repo").alias(f"{name}_repo"), *[F.col(flag).alias(f"{name}_{flag}") for flag in flags]
        )

    both = pairs.join(side("left"), "left_repo").join(side("right"), "right_repo")
    cells = ", ".join(f"'{flag}', left_{flag}, right_{flag}" for flag in flags)
    return both.selectExpr(
        "left_repo", "right_repo", f"stack({len(flags)}, {cells}) AS (practice, left_has, right_has)"
    )


def pair_workflows(pairs: DataFrame, workflows: DataFrame) -> DataFrame:
    """Workflow names that only one repo of a pair has.

    Names are tagged with their side and met in one aggregate by (pair, name); no two repos' lists are ever
    compared with each other.  Pairs with an unknown repo give nothing.
    """
    sides = pairs.selectExpr("left_repo", "right_repo", "stack(2, 'left', left_repo, 'right', right_repo) AS (side, repo)")
    known = sides.join(workflows.select("repo").distinct(), "repo")
    complete = known.groupBy("left_repo", "right_repo").agg(F.count_distinct("side").alias("_sides"))
    usable = sides.join(complete.where("_sides = 2"), ["left_repo", "right_repo"], "left_semi")
    named = usable.join(workflows.select("repo", "workflow_name"), "repo")
    met = named.groupBy("left_repo", "right_repo", "workflow_name").agg(
        F.bool_or(F.col("side") == "left").alias("_left"), F.bool_or(F.col("side") == "right").alias("_right")
    )
    side = F.when(F.col("_left"), "left").otherwise("right")
    return met.where(F.col("_left") != F.col("_right")).withColumn("side", side).drop("_left", "_right")


def repo_advice(detail: DataFrame, scores: DataFrame) -> DataFrame:
    """Missing practices, then security advice; the first eight lines per repo."""
    missing = repos.repo_maturity(detail).select(
        "repo", F.transform("missing_en", lambda name: F.concat(F.lit("Add "), name, F.lit("."))).alias("_missing")
    )
    advised = scores.select("repo", security.advice().alias("_advice"))
    lines = F.slice(F.concat("_missing", F.coalesce("_advice", text.strings(()))), 1, ADVICE_SHOWN)
    return missing.join(advised, "repo", "left").select("repo", F.posexplode(lines).alias("position", "advice"))


def flaky_signal(facts: DataFrame) -> DataFrame:
    return patterns.pattern_adoption(facts).where(F.col("slug") == "flaky-test-retry").select("slug", "repo_count")


def patterns_in_category(facts: DataFrame, category: str) -> DataFrame:
    return patterns.pattern_adoption(facts).where(F.col("category") == category).select(
        "slug", "name", "repo_count", "adoption_pct"
    )


def examples_of(detail: DataFrame, slug: str) -> DataFrame:
    """Examples of one pattern; only its rule is evaluated."""
    return patterns.pattern_examples(detail, slugs=(slug,))


def health_check(scan: DataFrame) -> DataFrame:
    """Per-repo health from the raw text scan of all its files.

    Each file gives one row per tool (or one without); counted by (repo, tool) first, then by repo.
    """
    rows = scan.select(
        "repo", "has_matrix", "has_permissions", "has_ai_review",
        F.posexplode_outer(F.array_distinct("security_tools")).alias("_pos", "tool"),
    )
    itself = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    counted = rows.groupBy("repo").agg(
        F.count_if(itself).alias("workflow_count"),
        F.count_if(itself & F.col("has_permissions")).alias("_permitted"),
        F.count_distinct("tool").alias("security_tools"),
        F.bool_or("has_matrix").alias("has_matrix"),
        F.bool_or("has_ai_review").alias("has_ai_review"),
    )
    coverage = F.floor(share(F.col("_permitted"), F.col("workflow_count")) * 100 + 0.5)
    advice = F.concat_ws(
        ",",
        F.when(F.col("_permitted") < F.col("workflow_count"), "permissions"),
        F.when(F.col("security_tools") == 0, "scanner"),
        F.when(~F.col("has_matrix"), "matrix"),
    )
    return counted.select(
        "repo",
        "workflow_count",
        coverage.alias("permissions_coverage_pct"),
        "security_tools",
        "has_matrix",
        "has_ai_review",
        (F.col("security_tools") > 0).alias("has_security_scan"),
        advice.alias("advice"),
    )


def trend_counters(changes: DataFrame, pattern_changes: DataFrame, configs: DataFrame, structure: DataFrame) -> DataFrame:
    """Long table of the trend page's counters."""

    def counter(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("value")).select(
            F.lit(name).alias("counter"), "value"
        )

    both = changes.agg(
        F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed")
    )
    return (
        both.selectExpr("stack(2, 'added_workflows', added, 'removed_workflows', removed) AS (counter, value)")
        .unionByName(counter(pattern_changes, "changed_repos", F.count_distinct("repo")))
        .unionByName(
            counter(configs, "tsconfig_strict", F.count_if((F.col("kind") == "tsconfig") & F.col("strict")))
        )
        .unionByName(
            counter(configs, "cargo_workspaces", F.count_if((F.col("kind") == "cargo") & F.col("workspace")))
        )
        .unionByName(
            counter(
                structure,
                "release_strategy_repos",
                F.max(F.when(F.col("signal") == "release_strategy", F.col("repo_count"))),
            )
        )
    )


def raw_sources(detail: DataFrame, files: DataFrame) -> DataFrame:
    """Raw text of each workflow, matched by repo and file name."""
    named = detail.select(
        "repo", "workflow_name", F.substring_index("source_file", "/", -1).alias("file_name")
    )
    return named.join(files.select("repo", "file_name", "content"), ["repo", "file_name"])
