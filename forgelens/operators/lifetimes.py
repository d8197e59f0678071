"""Validity intervals of keys (workflows, patterns of a repo) over all snapshots.

An interval has the first and the last snapshot of an unbroken run and ``gone_at``, the snapshot in which the key was
missing again (null while it is still there).  A key that comes back starts another interval.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INTERVAL = ("first_seen", "last_seen", "gone_at")


def lifetimes(members: DataFrame, *keys: str, snapshots: DataFrame | None = None) -> DataFrame:
    """Intervals of a (snapshot, keys) table; repeats do not matter.

    ``snapshots`` lists the snapshots taken, by default those with any member; one in which nothing was found must be
    listed to end runs.  The windows are over the list of snapshots and over the snapshots of one key, in which repeats
    share a rank.
    """
    taken = (members if snapshots is None else snapshots).select("snapshot").distinct()
    in_time = Window.orderBy("snapshot")
    numbered = taken.select(
        "snapshot", F.row_number().over(in_time).alias("_n"), F.lead("snapshot").over(in_time).alias("_next")
    )
    # one row a snapshot
    present = members.select("snapshot", *keys).join(F.broadcast(numbered), "snapshot")
    runs = present.withColumn("_run", F.col("_n") - F.dense_rank().over(Window.partitionBy(*keys).orderBy("_n")))
    return runs.groupBy(*keys, "_run").agg(
        F.min("snapshot").alias("first_seen"), F.max("snapshot").alias("last_seen"), F.max_by("_next", "_n").alias("gone_at")
    ).drop("_run")


def merged(intervals: DataFrame, members: DataFrame, snapshot, *keys: str) -> DataFrame:
    """Intervals after one more, later snapshot, whose keys are ``members``; earlier snapshots are not read.

    Only open intervals meet the new keys, in one combining aggregate; closed ones pass unchanged.  Merging a snapshot again
    changes nothing.
    """
    at = F.lit(snapshot).cast(intervals.schema["last_seen"].dataType)
    was = intervals.where("gone_at IS NULL").select(*keys, "first_seen", "last_seen", F.lit(False).alias("_now"))
    now = members.select(*keys, *[F.lit(None).cast(at_type).alias(name) for name, at_type in _types(intervals)], F.lit(True).alias("_now"))
    met = was.unionByName(now).groupBy(*keys).agg(
        F.max("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.bool_or("_now").alias("_now")
    )
    updated = met.select(
        *keys,
        F.coalesce("first_seen", at).alias("first_seen"),
        F.when(F.col("_now"), at).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(~F.col("_now"), at).alias("gone_at"),
    )
    return intervals.where("gone_at IS NOT NULL").select(*keys, *INTERVAL).unionByName(updated)


def _types(intervals: DataFrame):
    return [(name, intervals.schema[name].dataType) for name in INTERVAL[:2]]


def alive_at(intervals: DataFrame, snapshot) -> DataFrame:
    """Keys that a snapshot held."""
    at = F.lit(snapshot).cast(intervals.schema["last_seen"].dataType)
    return intervals.where((F.col("first_seen") <= at) & (F.col("last_seen") >= at)).drop(*INTERVAL)


def changes_between(intervals: DataFrame, previous, current, *keys: str) -> DataFrame:
    """Keys added or removed between any two snapshots, from the intervals alone."""

    def at(snapshot):
        day = F.lit(snapshot).cast(intervals.schema["last_seen"].dataType)
        return F.bool_or((F.col("first_seen") <= day) & (F.col("last_seen") >= day))

    sides = intervals.groupBy(*keys).agg(at(previous).alias("_before"), at(current).alias("_after"))
    changed = sides.where(F.col("_before") != F.col("_after"))
    return changed.select(*keys, F.when(F.col("_after"), "added").otherwise("removed").alias("change"))
