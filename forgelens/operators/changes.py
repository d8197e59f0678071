"""Differences between snapshots."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgelens.operators.insights import group_metrics

LISTED_REPOS = 20
METRICS = (
    ("matrix_usage_percentage", "matrix_pct"),
    ("permissions_usage_percentage", "permissions_pct"),
    ("ai_review_count", "ai_repos"),
    ("total_repos", "total_repos"),
    ("total_workflows", "total_workflows"),
)


def membership(previous: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of two tables with the side(s) they are on.

    Union and one combining aggregate instead of two distincts and an outer join: repeats vanish before the
    shuffle, whichever key they pile up on.
    """
    tagged = previous.select(*keys, F.lit(True).alias("in_previous"), F.lit(False).alias("in_current")).unionByName(
        current.select(*keys, F.lit(False).alias("in_previous"), F.lit(True).alias("in_current"))
    )
    return tagged.groupBy(*keys).agg(
        F.bool_or("in_previous").alias("in_previous"), F.bool_or("in_current").alias("in_current")
    )


def _change() -> Column:
    return F.when(F.col("in_current"), "added").otherwise("removed")


def workflow_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Workflows, by repo and name, that are only in one of two snapshots."""
    sides = membership(previous, current, "repo", "workflow_name")
    changed = sides.where(F.col("in_previous") != F.col("in_current"))
    return changed.select("repo", "workflow_name", _change().alias("change"))


def workflows_added(previous: DataFrame, current: DataFrame) -> DataFrame:
    return workflow_changes(previous, current).where(F.col("change") == "added").drop("change")


def workflows_removed(previous: DataFrame, current: DataFrame) -> DataFrame:
    return workflow_changes(previous, current).where(F.col("change") == "removed").drop("change")


def pattern_changes(patterns: DataFrame, previous: str = "previous", current: str = "current") -> DataFrame:
    """Patterns that a repo gained or lost, from one (snapshot, repo, slug) table."""
    sides = patterns.groupBy("repo", "slug").agg(
        F.bool_or(F.col("snapshot") == previous).alias("in_previous"),
        F.bool_or(F.col("snapshot") == current).alias("in_current"),
    )
    changed = sides.where(F.col("in_previous") != F.col("in_current"))
    return changed.select("repo", "slug", _change().alias("change"))


def changed_repos(changes: DataFrame) -> DataFrame:
    """Pattern changes per repo; a repo's lists hold at most one entry per defined pattern."""
    added = F.sort_array(F.collect_list(F.when(F.col("change") == "added", F.col("slug"))))
    removed = F.sort_array(F.collect_list(F.when(F.col("change") == "removed", F.col("slug"))))
    return changes.groupBy("repo").agg(added.alias("added_patterns"), removed.alias("removed_patterns"))


def changed_repos_listed(changes: DataFrame, limit: int = LISTED_REPOS) -> DataFrame:
    """The first changed repos by name, as shown in the report."""
    return changed_repos(changes).orderBy("repo").limit(limit)


def _long_metrics(metrics: DataFrame) -> DataFrame:
    cells = ", ".join(f"'{name}', cast({column} AS double)" for name, column in METRICS)
    return metrics.selectExpr("grp", f"stack({len(METRICS)}, {cells}) AS (metric, curr_value)")


def metric_diffs(workflows: DataFrame, snapshot: Column) -> DataFrame:
    """Changed metrics between each snapshot and the one before it.

    Metrics are a handful of rows per snapshot; the first snapshot has no predecessor and gives no rows.
    """
    long = _long_metrics(group_metrics(workflows, snapshot))
    order = Window.partitionBy("metric").orderBy("grp")
    paired = long.withColumn("prev_value", F.lag("curr_value").over(order))
    return paired.where(F.col("prev_value") != F.col("curr_value")).select(
        F.col("grp").alias("snapshot"),
        "metric",
        "prev_value",
        "curr_value",
        F.bround(F.col("curr_value") - F.col("prev_value"), 6).alias("delta"),
    )


def two_snapshot_diffs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Changed metrics between two snapshots; a metric that is absent counts as zero."""
    tagged = previous.withColumn("_side", F.lit("previous")).unionByName(
        current.withColumn("_side", F.lit("current")), allowMissingColumns=True
    )
    long = _long_metrics(group_metrics(tagged, F.col("_side")))
    wide = long.groupBy("metric").agg(
        F.coalesce(F.max(F.when(F.col("grp") == "previous", F.col("curr_value"))), F.lit(0.0)).alias("prev_value"),
        F.coalesce(F.max(F.when(F.col("grp") == "current", F.col("curr_value"))), F.lit(0.0)).alias("curr_value"),
    )
    return wide.where(F.col("prev_value") != F.col("curr_value")).withColumn(
        "delta", F.bround(F.col("curr_value") - F.col("prev_value"), 6)
    )


def on_shared_repos(previous: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both snapshots restricted to the repos they share, so that trends do not mix in a changed universe."""
    shared = membership(previous, current, "repo").where("in_previous AND in_current").select("repo")
    return previous.join(shared, "repo", "left_semi"), current.join(shared, "repo", "left_semi")


def previous_snapshot(workflows: DataFrame, current_date: Column) -> DataFrame:
    """The latest snapshot before a date; empty when there is none."""
    earlier = workflows.where(F.col("crawl_date") < current_date)
    latest = earlier.agg(F.max("crawl_date").alias("crawl_date"))
    # one row
    return earlier.join(F.broadcast(latest), "crawl_date", "left_semi")
