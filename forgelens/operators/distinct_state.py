"""Mergeable exact distinct counts: bitmaps of repo numbers per snapshot and metric.

Repos get dense numbers that never change.  A state row is one bitmap of 32,768 numbers (4 KB), so a snapshot of a million
repos is 31 rows a metric.  Unions over any set of snapshots, cumulative counts and intersections come from the state; the
workflow rows of a snapshot are read once, when its state is built.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgelens.functions.ranking import numbered

NUMBERS = "repo string, number bigint"
STATE = ("snapshot", "metric", "bucket", "bits")


def with_new_repos(numbers: DataFrame, repos: DataFrame) -> DataFrame:
    """The numbers, and the next free ones for repos that have none, by name."""
    known = numbers.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    fresh = repos.select("repo").where("repo IS NOT NULL").distinct().join(numbers, "repo", "left_anti")
    added = numbered(fresh, [("repo", False)], "number").select("repo", (F.col("number") - 1 + known).alias("number"))
    return numbers.unionByName(added)


def state_of(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """State of (snapshot, metric, repo) rows; repeats do not matter.

    Bitmaps are combined map-side, so however many workflows a repo has, a task sends a bucket once.
    """
    held = rows.select("snapshot", "metric", "repo").distinct().join(numbers, "repo")
    position = held.number + 1  # the built-in functions number from 1
    return held.groupBy("snapshot", "metric", F.bitmap_bucket_number(position).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits")
    )


def union_counts(state: DataFrame, *by: str) -> DataFrame:
    """Distinct repos by metric (and ``by``) over all snapshots in ``state``."""
    merged = state.groupBy("metric", *by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("metric", *by).agg(F.sum(F.bitmap_count("bits")).alias("repos"))


def cumulative_counts(state: DataFrame) -> DataFrame:
    """Distinct repos of each metric up to each snapshot that has any.

    A bucket's bitmaps are merged along its own snapshots; what each adds is summed over buckets, then over time.
    """
    along = Window.partitionBy("metric", "bucket").orderBy("snapshot")
    merged = state.withColumn("_so_far", F.bitmap_count(F.bitmap_or_agg("bits").over(along)))
    added = merged.withColumn("_added", F.col("_so_far") - F.coalesce(F.lag("_so_far").over(along), F.lit(0)))
    by_snapshot = added.groupBy("snapshot", "metric").agg(F.sum("_added").alias("_added"))
    over_time = Window.partitionBy("metric").orderBy("snapshot")
    return by_snapshot.select("snapshot", "metric", F.sum("_added").over(over_time).alias("repos"))


def shared_counts(state: DataFrame, everyone: str = "repos") -> DataFrame:
    """Repos of each metric in each snapshot, among those that it and the snapshot before it hold (metric ``everyone``)."""
    snapshots = state.select("snapshot").distinct()
    pairs = snapshots.withColumn("previous", F.lag("snapshot").over(Window.orderBy("snapshot")))
    members = state.where(F.col("metric") == everyone)
    now = members.select("snapshot", "bucket", F.col("bits").alias("_now"))
    then = members.select(F.col("snapshot").alias("previous"), "bucket", F.col("bits").alias("_then"))
    met = state.join(pairs, "snapshot").join(now, ["snapshot", "bucket"]).join(then, ["previous", "bucket"])
    sides = met.select("snapshot", "metric", "bucket", F.explode(F.array("bits", "_now", "_then")).alias("_side"))
    both = sides.groupBy("snapshot", "metric", "bucket").agg(F.bitmap_and_agg("_side").alias("bits"))
    counted = both.groupBy("snapshot", "metric").agg(F.sum(F.bitmap_count("bits")).alias("repos"))
    return counted.where("repos > 0")
