"""Reach of reusable workflows: who runs a shared workflow, directly or through others.

Only workflows that are called themselves can extend a chain.  The closure is therefore found on the calls between
those alone, in rounds that join the pairs found last with the calls and keep what is new, so cycles end; the many
workflows that nobody calls meet the finished closure in one join.  Every round is a written table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens.sources.workspace import written

PAIR = ["caller", "callee"]


def _target(repo: Column, uses: Column) -> Column:
    """Path of a called file: without its version, local ones (``./``) in the caller's repo."""
    path = F.split_part(uses, F.lit("@"), F.lit(1))
    return F.when(path.startswith("./"), F.concat(repo, F.lit("/"), F.substring(path, 3, 1 << 20))).otherwise(path)


def calls(workflows: DataFrame) -> DataFrame:
    """Distinct (caller, callee) file paths, calls of a file by itself included."""
    used = workflows.select("repo", "workflow_path", F.explode("reusable_workflows").alias("_uses"))
    return used.where("_uses IS NOT NULL").select(
        F.concat("repo", F.lit("/"), "workflow_path").alias("caller"), _target(F.col("repo"), F.col("_uses")).alias("callee")
    ).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(caller, callee, depth): all pairs joined by a chain of calls, with the length of the shortest."""
    edges = written(edges.select(*PAIR).distinct(), "calls")
    called = edges.select(F.col("callee").alias("caller")).distinct()
    inner = written(edges.join(called, "caller", "left_semi"), "inner-calls")
    step = inner.select(F.col("caller").alias("callee"), F.col("callee").alias("_next"))
    last = written(inner.withColumn("depth", F.lit(1)), "chains")
    known, depth = last, 1
    while not last.isEmpty():
        depth += 1
        further = last.join(step, "callee").select("caller", F.col("_next").alias("callee")).distinct()
        last = written(further.join(known, PAIR, "left_anti").withColumn("depth", F.lit(depth)), "chains")
        known = known.unionByName(last)
    through = edges.withColumnRenamed("callee", "_via").join(
        known.select(F.col("caller").alias("_via"), "callee", F.col("depth") + 1), "_via"
    ).toDF("_via", "caller", "callee", "depth").drop("_via")
    # by caller alone: all rows of a call come one after another and stay together, so that they are compressed well; there is
    # next to nothing to combine before the shuffle
    chains = edges.withColumn("depth", F.lit(1)).unionByName(through).repartition("caller")
    return chains.groupBy(*PAIR).agg(F.min("depth").alias("depth"))


def reach(chains: DataFrame) -> DataFrame:
    """Of every called file: callers with a direct call, all callers but itself, longest shortest chain, and whether it is
    in a cycle."""
    others = F.col("caller") != F.col("callee")
    return chains.groupBy(F.col("callee").alias("workflow")).agg(
        F.count_if(others & (F.col("depth") == 1)).alias("direct_callers"),
        F.count_if(others).alias("callers"),
        F.coalesce(F.max(F.when(others, F.col("depth"))), F.lit(0)).alias("longest_chain"),
        F.bool_or(~others).alias("in_cycle"),
    )
