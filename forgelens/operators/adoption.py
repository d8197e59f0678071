"""Corpus-wide adoption statistics over the workflow table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgelens import rules
from forgelens.functions import text
from forgelens.functions.literals import rule_table
from forgelens.functions.numeric import any_true, count_true, percentage

TOP_ACTIONS = 50
TOP_FINGERPRINTS = 10
EXAMPLES_PER_FINGERPRINT = 3


def per_repo_flags(workflows: DataFrame) -> DataFrame:
    """One row per repo with its any-flags; combines map-side, so a repo of any size is one small row."""
    return workflows.groupBy("repo").agg(
        F.count("*").alias("workflow_count"),
        count_true(F.col("has_permissions_block")).alias("with_permissions"),
        any_true(F.col("uses_matrix")).alias("has_matrix"),
        any_true(F.col("has_ai_review")).alias("has_ai_review"),
        any_true(F.col("has_security_scan")).alias("has_security_scan"),
    )


def totals(workflows: DataFrame) -> DataFrame:
    return per_repo_flags(workflows).agg(
        F.count("*").alias("total_repos"), F.coalesce(F.sum("workflow_count"), F.lit(0)).alias("total_workflows")
    )


def matrix_usage(workflows: DataFrame) -> DataFrame:
    counted = per_repo_flags(workflows).agg(
        F.count("*").alias("total_repos"), count_true(F.col("has_matrix")).alias("matrix_repos")
    )
    return counted.withColumn("percentage", percentage(F.col("matrix_repos"), F.col("total_repos")))


def permissions_usage(workflows: DataFrame) -> DataFrame:
    counted = workflows.agg(
        F.count("*").alias("total_workflows"),
        count_true(F.col("has_permissions_block")).alias("with_permissions"),
    )
    return counted.withColumn("percentage", percentage(F.col("with_permissions"), F.col("total_workflows")))


def adoption_counts(workflows: DataFrame) -> DataFrame:
    """Repos with AI review and with security scanning."""
    return per_repo_flags(workflows).agg(
        F.count("*").alias("total_repos"),
        F.count_if("has_ai_review").alias("ai_review_repos"),
        F.count_if("has_security_scan").alias("security_scan_repos"),
    )


def list_usage(workflows: DataFrame, column: str, name: str) -> DataFrame:
    """Occurrences of each element of an array column and the repos that have it."""
    used = workflows.select("repo", F.explode(column).alias(name)).where(F.col(name) != "")
    per_repo = used.groupBy(name, "repo").agg(F.count("*").alias("_uses"))
    return per_repo.groupBy(name).agg(F.sum("_uses").alias("usage_count"), F.count("*").alias("repo_count"))


def action_counts(workflows: DataFrame, *group: str) -> DataFrame:
    used = workflows.select(*group, F.explode("actions_normalized").alias("action"))
    return used.where(F.col("action") != "").groupBy(*group, "action").agg(F.count("*").alias("usage_count"))


def popular_actions(workflows: DataFrame, limit: int = TOP_ACTIONS) -> DataFrame:
    """Most used actions, every occurrence counted."""
    top = action_counts(workflows).orderBy(F.desc("usage_count"), "action").limit(limit)
    return top.select(F.trim("action").alias("action"), "usage_count")


def action_category(action: Column) -> Column:
    """Category of an action: its exact name, else the first listed prefix, else the catch-all."""
    exact = F.create_map(*[F.lit(word) for category, name in rules.ACTION_CATEGORIES for word in (name, category)])
    prefixes = [F.when(action.startswith(name), category) for category, name in rules.ACTION_CATEGORIES]
    return F.coalesce(F.try_element_at(exact, action), *prefixes, F.lit(rules.OTHER_CATEGORY))


def actions_categorized(actions: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Add category, description and repository page to counted actions."""
    result = actions.withColumns(
        {"category": action_category(F.col("action")), "url": text.action_url(F.col("action"))}
    )
    if descriptions is None:
        return result.withColumn("description", F.lit(""))
    joined = result.join(descriptions.select("action", "description"), "action", "left")
    return joined.withColumn("description", F.coalesce("description", F.lit("")))


def category_usage(workflows: DataFrame) -> DataFrame:
    """Uses and distinct actions per category over every action of the corpus."""
    counted = action_counts(workflows).withColumn("category", action_category(F.col("action")))
    return counted.groupBy("category").agg(
        F.sum("usage_count").alias("usage_count"), F.count("*").alias("action_count")
    )


def ai_adoption(workflows: DataFrame) -> DataFrame:
    """AI-review actions of each adopting repo, in order of first appearance."""
    used = workflows.where("has_ai_review").select(
        "repo", "workflow_name", F.posexplode("ai_review_actions").alias("_pos", "action")
    )
    first = (
        used.where(F.col("action") != "")
        .groupBy("repo", "action")
        .agg(F.min(F.struct("workflow_name", "_pos")).alias("_first"))
    )
    order = Window.partitionBy("repo").orderBy("_first", "action")
    return first.select(
        "repo",
        F.row_number().over(order).cast("bigint").alias("position"),
        "action",
        text.repo_url(F.col("repo")).alias("url"),
    )


def ai_repos(workflows: DataFrame) -> DataFrame:
    return workflows.where("has_ai_review").select("repo").distinct()


def ai_tool_breakdown(workflows: DataFrame) -> DataFrame:
    """Adopting repos per AI-review action, with what is known about the tool."""
    used = workflows.where("has_ai_review").select("repo", F.explode("ai_review_actions").alias("action"))
    counts = (
        used.where(F.col("action") != "").distinct().groupBy("action").agg(F.count("*").alias("repo_count"))
    )
    tools = rule_table(
        workflows.sparkSession,
        ("action", "tool_name", "model", "approach", "prompt_style"),
        rules.AI_REVIEW_TOOLS,
    )
    # the tool table has as many rows as the code lists
    joined = counts.join(F.broadcast(tools), "action", "left")
    return joined.withColumn("url", text.repo_url(F.col("action"))).orderBy(F.desc("repo_count"), "action")


def fingerprinted(workflows: DataFrame) -> DataFrame:
    """Workflows that use actions, with the md5 of their sorted action multiset."""
    parts = F.array_sort(F.filter("actions_normalized", lambda action: action != ""))
    return (
        workflows.where(F.size("actions_normalized") > 0)
        .select("repo", "workflow_name", F.array_join(parts, ",").alias("actions"))
        .withColumn("fingerprint", F.md5("actions"))
    )


def fingerprints(workflows: DataFrame, limit: int = TOP_FINGERPRINTS) -> DataFrame:
    counted = fingerprinted(workflows).groupBy("fingerprint", "actions").agg(F.count("*").alias("usage_count"))
    return counted.orderBy(F.desc("usage_count"), "fingerprint").limit(limit)


def fingerprint_examples(workflows: DataFrame, limit: int = TOP_FINGERPRINTS) -> DataFrame:
    """First distinct repos of each top fingerprint."""
    # at most ``limit`` rows
    top = F.broadcast(fingerprints(workflows, limit).select("fingerprint"))
    repos = fingerprinted(workflows).select("fingerprint", "repo").join(top, "fingerprint", "left_semi").distinct()
    order = Window.partitionBy("fingerprint").orderBy("repo")
    ranked = repos.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= EXAMPLES_PER_FINGERPRINT).withColumn(
        "position", F.col("position").cast("bigint")
    )


def security_scan_repos(workflows: DataFrame) -> DataFrame:
    return workflows.where("has_security_scan").select("repo").distinct()


def distinct_actions(workflows: DataFrame) -> DataFrame:
    return workflows.select(F.explode("actions_normalized").alias("action")).where(
        F.col("action").isNotNull()
    ).distinct()


def missing_descriptions(workflows: DataFrame, known: DataFrame) -> DataFrame:
    """Actions that are neither local nor described yet."""
    remote = distinct_actions(workflows).where(~F.col("action").startswith("."))
    return remote.join(known.select("action"), "action", "left_anti")


def ai_action_discovery(candidates: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Names of AI-review actions: starred candidates, well-known ones, and those whose description says so."""
    starred = candidates.where(F.col("stars") >= rules.MIN_AI_CANDIDATE_STARS).select(
        F.col("full_name").alias("action")
    )
    well_known = rule_table(
        candidates.sparkSession, ("action",), [(name,) for name in rules.WELL_KNOWN_AI_ACTIONS]
    )
    described = descriptions.where(text.found(F.col("description"), rules.AI_DESCRIPTION)).select("action")
    return starred.unionByName(well_known).unionByName(described).distinct()


def action_share(workflows: DataFrame, limit: int = 15) -> DataFrame:
    """Top actions with their share of the largest one shown."""
    top = actions_categorized(popular_actions(workflows, limit))
    # a window over the ``limit`` rows just kept
    largest = F.max("usage_count").over(Window.partitionBy())
    return top.select(
        "action", "category", "usage_count", (F.col("usage_count") / largest).alias("share_of_largest")
    )
