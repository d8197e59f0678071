"""Threshold rules over adoption metrics, evaluated for every group of repos at once."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgelens import rules
from forgelens.functions import text
from forgelens.functions.numeric import any_true, count_true, percentage
from forgelens.operators import adoption

TOP_FOR_SURPRISE = 10


def group_metrics(workflows: DataFrame, group: Column) -> DataFrame:
    """Adoption metrics per group; repos are reduced to one row each before they are counted."""
    per_repo = (
        workflows.withColumn("grp", group)
        .groupBy("grp", "repo")
        .agg(
            F.count("*").alias("workflows"),
            count_true(F.col("has_permissions_block")).alias("with_permissions"),
            any_true(F.col("uses_matrix")).alias("has_matrix"),
            any_true(F.col("has_ai_review")).alias("has_ai_review"),
            any_true(F.col("has_security_scan")).alias("has_security_scan"),
        )
    )
    counted = per_repo.groupBy("grp").agg(
        F.count("*").alias("total_repos"),
        F.sum("workflows").alias("total_workflows"),
        F.sum("with_permissions").alias("with_permissions"),
        count_true(F.col("has_matrix")).alias("matrix_repos"),
        count_true(F.col("has_ai_review")).alias("ai_repos"),
        count_true(F.col("has_security_scan")).alias("scan_repos"),
    )
    return counted.withColumns(
        {
            "matrix_pct": percentage(F.col("matrix_repos"), F.col("total_repos")),
            "permissions_pct": percentage(F.col("with_permissions"), F.col("total_workflows")),
        }
    )


def top_group_actions(workflows: DataFrame, group: Column, limit: int) -> DataFrame:
    counts = adoption.action_counts(workflows.withColumn("grp", group), "grp")
    order = Window.partitionBy("grp").orderBy(F.desc("usage_count"), "action")
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def surprising_actions(workflows: DataFrame, group: Column | None = None) -> DataFrame:
    """Unofficial actions among the ten most used ones of each group."""
    top = top_group_actions(workflows, _group(group), TOP_FOR_SURPRISE)
    official = F.col("action").startswith("actions/") | F.col("action").startswith("docker/")
    return top.where(~official).select(
        "grp", F.col("position").cast("bigint").alias("position"), "action", "usage_count"
    )


def _group(group: Column | None) -> Column:
    return text.owner_of(F.col("repo")) if group is None else group


def _fired(rules_and_values) -> Column:
    """Rows of the rules whose condition holds: structs of (rule_key, value, ...) literals and columns."""
    return F.inline(
        F.array_compact(F.array(*[F.when(condition, F.struct(*fields)) for condition, fields in rules_and_values]))
    )


def insight_flags(workflows: DataFrame, group: Column | None = None) -> DataFrame:
    """Insight rules that hold for each group, with the value each rests on."""
    surprises = surprising_actions(workflows, group).groupBy("grp").agg(F.count("*").alias("surprises"))
    metrics = group_metrics(workflows, _group(group)).join(surprises, "grp", "left")
    matrix, permissions = F.col("matrix_pct"), F.col("permissions_pct")

    def rule(condition, key, value):
        return condition, (F.lit(key).alias("rule_key"), value.cast("double").alias("value"))

    ai_pct = percentage(F.col("ai_repos"), F.col("total_repos"), 1)
    scan_pct = percentage(F.col("scan_repos"), F.col("total_repos"), 1)
    fired = _fired(
        [
            rule(matrix >= 70, "matrix_high", matrix),
            rule((matrix >= 40) & (matrix < 70), "matrix_moderate", matrix),
            rule(permissions < 50, "permissions_low", permissions),
            rule(permissions >= 50, "permissions_good", permissions),
            rule(F.col("ai_repos") > 0, "ai_review", ai_pct),
            rule(F.col("surprises") > 0, "surprising_actions", F.col("surprises")),
            rule(F.col("scan_repos") > 0, "security_scan", scan_pct),
        ]
    )
    return metrics.select("grp", fired)


def recommendation_flags(workflows: DataFrame, group: Column | None = None) -> DataFrame:
    """Recommendation rules that hold for each group, with priority and value."""
    popular = top_group_actions(workflows, _group(group), adoption.TOP_ACTIONS)
    cached = (
        popular.where(F.contains(F.lower("action"), F.lit(rules.CACHE)))
        .groupBy("grp")
        .agg(F.sum("usage_count").alias("cache_uses"))
    )
    metrics = group_metrics(workflows, _group(group)).join(cached, "grp", "left")

    def rule(condition, priority, key, value):
        return condition, (
            F.lit(priority).alias("priority"),
            F.lit(key).alias("rule_key"),
            value.cast("double").alias("value"),
        )

    fired = _fired(
        [
            rule(F.col("matrix_pct") >= 50, "high", "add_matrix", F.col("matrix_pct")),
            rule(F.col("permissions_pct") >= 30, "high", "set_permissions", F.col("permissions_pct")),
            rule(F.col("cache_uses").isNotNull(), "medium", "use_cache", F.col("cache_uses")),
            rule(F.col("ai_repos") > 0, "medium", "try_ai_review", F.col("ai_repos")),
        ]
    )
    return metrics.select("grp", fired)
