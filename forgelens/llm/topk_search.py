"""Exact top-k search by integer inner product: sorted lists without random access (NRA).

Vectors become integers floor(256 * x).  Candidates are dealt over shards by a hash; a shard keeps one list per
dimension, sorted by value, as positions and values.  A query reads all lists in step from the end that its sign
favours (largest contributions first) and keeps for every candidate met the sum so far and the set of lists where it
was met.  For the others of its lists a candidate can have at most the value just read and at least the last one of the
list: upper and lower bounds of its score.  Reading stops when the k-th largest lower bound is above the upper bound of
all but the candidates that are left, or all lists are read; the scores of those left are then resolved, and
the best k of the shards merged.  Queries meet candidates in blocks (query block, shard); every pair of blocks is one
bounded group.

Ties go to the smaller vec_id.  Defined results: vectors that are null, hold null or non-finite components, have another
length than most (the first by length in case of a tie), or have a null vec_id take no part; a query with fewer than k
other vectors returns all; rows that repeat a vec_id are one vector; an empty table gives an empty table.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

K = 5
SCALE = 256
QUERY_EVERY = 50
SHARD_VECTORS, BLOCK_QUERIES = 8192, 512
READS = (0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)  # shares of a list after which the bounds are compared
TOGETHER = 128  # queries of a matrix product
EXACT = 2.0**52
OUT = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): valid vectors as integer arrays, one a vec_id."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(sound).where(F.size("embedding") > 0)
    return rows.select("vec_id", whole.alias("v"))


def usual_length(rows: DataFrame) -> int:
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return sizes[0]["n"] if sizes else 0


class Lists:
    """The sorted lists of a shard, one a dimension: the place of every candidate and the values in descending order.

    A list is read from its upper end for positive weights and from its lower end for negative ones.  What all lists
    have given down to a depth is a matrix with zeros for what they have not, so a step of reading is done for many
    queries by matrix products.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        down = np.argsort(-self.vectors, axis=0, kind="stable")
        self.place = np.empty(down.shape, np.int32)
        np.put_along_axis(self.place, down, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)
        self.values = np.take_along_axis(self.vectors, down, axis=0).astype(np.float64)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the positions of a superset of its best k."""
        n = len(self.ids)
        whole, weights = self.vectors.astype(np.float64), queries.astype(np.float64)
        alive = self.ids[:, None] != own[None, :]
        most = np.abs(self.values[[0, -1]]).max(axis=0)
        todo = np.flatnonzero(np.abs(weights) @ most < EXACT)  # others: every candidate is resolved
        for share in READS:
            stop = round(share * n)
            if not stop or not len(todo):
                continue
            high, low = np.maximum(weights[todo], 0).T, np.minimum(weights[todo], 0).T
            upper_end, lower_end = self.place < stop, self.place >= n - stop
            given = (whole * upper_end) @ high + (whole * lower_end) @ low
            rest = (~upper_end).astype(np.float64), (~lower_end).astype(np.float64)
            # a list not met gives at most the value just read and at least its last one
            best = rest[0] @ (high * self.values[stop - 1][:, None]) + rest[1] @ (low * self.values[n - stop][:, None])
            least = rest[0] @ (high * self.values[-1][:, None]) + rest[1] @ (low * self.values[0][:, None])
            mine = alive[:, todo]
            lower = np.where(mine, given + least, -np.inf)
            bar = np.partition(lower, n - min(k, n), axis=0)[n - min(k, n)]
            mine &= given + best >= bar
            alive[:, todo] = mine
            todo = todo[mine.sum(axis=0) > 4 * k]
        return [np.flatnonzero(column) for column in alive.T]

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(vec_ids, scores) of the best k; scores that the lists have not given in full are resolved."""
        out = []
        for query, at in zip(queries, self.top(queries, own, k)):
            scores = self.vectors[at] @ query
            first = np.lexsort((self.ids[at], -scores))[:k]
            out.append((self.ids[at][first], scores[first]))
        return out


def search_block(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(shard):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    lists = Lists(shard["vec_id"].to_numpy(np.int64), np.stack(shard["v"].to_list()).astype(np.int64))
    asked, vectors = queries["vec_id"].to_numpy(np.int64), np.stack(queries["v"].to_list()).astype(np.int64)
    out = []
    for at in range(0, len(asked), TOGETHER):
        own = asked[at : at + TOGETHER]
        for query_id, (ids, scores) in zip(own, lists.best(vectors[at : at + TOGETHER], own, k)):
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores}))
    return pd.concat(out, ignore_index=True).astype("int64")


def _cell(column: str, count: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every query."""
    rows = written(usable(vectors).dropDuplicates(["vec_id"]), "vectors")
    rows = rows.where(F.size("v") == usual_length(rows))
    queries = rows.where(is_query)
    shards = max(4, -(-rows.count() // SHARD_VECTORS))
    blocks = max(4, -(-queries.count() // BLOCK_QUERIES))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = queries.withColumn("block", _cell("vec_id", blocks)).withColumn("shard", every(shards))
    held = rows.withColumn("shard", _cell("vec_id", shards)).withColumn("block", every(blocks))
    found = (
        asked.groupBy("block", "shard").cogroup(held.groupBy("block", "shard"))
        .applyInPandas(lambda left, right: search_block(left, right, k), OUT)
    )
    best = found.groupBy("query_id").agg(  # k rows a shard at most
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id"))), 1, k).alias("best")
    )
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.order")).alias("score")
    )


def query(spark, sf_dir) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % QUERY_EVERY == 0)


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
