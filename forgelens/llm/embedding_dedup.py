"""Near-duplicate embeddings: HNSW graphs per shard, cosine checked in double precision, linked ones united.

Equal vectors are one class from the start.  Classes are dealt over shards by a hash; each shard gets a graph (hnsw.py),
and every class queries every shard.  Before, an audit takes for each shard the narrowest of the ``WIDTHS`` of a beam that
found ``LINK_RECALL`` of the links of one query in ``AUDIT_EVERY`` (a scan tells them) and ``PROBE_RECALL`` of the targets of
``PROBES`` probes a block: nodes of the shard turned away until their cosine to the node is ``MIN_COSINE``, the farthest a
link can be.  Probes have power where links are rare.  A shard in which no width passes is scanned; the widths are logged.

A class with few links in a shard returns them, and a link that one side found counts for both.  A class whose beam is
filled by more than half with possible links scans the shard, since there may be more than a beam holds; beyond ``FEW`` links
it returns their number, and the task a spanning forest of such links; a dense group is never written out as pairs.

``SHARD_VECTORS`` bounds a shard and ``BLOCK_QUERIES`` a block of queries, hence the memory of a task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different lengths; rows that repeat a vec_id are one vector (the least valid one); null vec_ids are left
out; an empty table gives an empty table.
"""

import logging

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hnsw
from .common import written
from .components import components, forest

MIN_COSINE = 0.95
LEAST_SHARDS, SHARD_VECTORS, BLOCK_QUERIES = 6, 65_536, 16_384
WIDTHS, FEW = (16, 32, 64, 128, 256, 512), 8
AUDIT_EVERY, PROBES = 16, 512
LINK_RECALL, PROBE_RECALL = 0.999, 0.995
SCAN_CELLS = 1 << 22
ROUNDING = 1e-4  # of single precision, in which the graph is searched
NODES = "dim int, shard int, node int, id long, copies long, embedding array<float>, links array<int>"
AUDIT = "dim int, shard int, width int, links long, links_found long, probes long, probes_found long"
FOUND = "kind string, a long, b long, n long"  # a link, an edge of a forest, or the number of links in a shard


def valid() -> Column:
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("embedding").isNotNull() & sound & F.exists("embedding", lambda x: x != 0)


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, id) of all valid vectors, and (id, copies, dim, embedding) of the classes of equal ones."""
    own = written(
        vectors.where("vec_id IS NOT NULL").where(valid()).groupBy("vec_id").agg(F.min("embedding").alias("embedding")),
        "vectors",
    )
    classes = own.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("dim", F.size("embedding")), "classes")
    return own.join(classes, "embedding").select("vec_id", "id", "copies"), classes


def _units(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Double-precision vectors of length 1, and the same in single precision."""
    raw = np.stack(frame["embedding"].to_list()).astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    raw /= np.linalg.norm(raw, axis=1, keepdims=True)
    return raw, raw.astype(np.float32)


def build_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of a shard in the order of their nodes, with the links of all their levels one after the other."""
    order = np.lexsort((frame["id"], pd.util.hash_array(frame["id"].to_numpy())))
    frame = frame.iloc[order].reset_index(drop=True)
    levels = hnsw.build(_units(frame)[1])
    links = [np.concatenate([level[i] for level in levels if i < len(level)]) for i in range(len(frame))]
    return frame.assign(node=np.arange(len(frame), dtype=np.int32), links=links)[
        ["dim", "shard", "node", "id", "copies", "embedding", "links"]
    ]


def _levels(frame: pd.DataFrame) -> list[np.ndarray]:
    links, out, at = frame["links"].to_list(), [], 0
    for size in hnsw.level_sizes(len(frame)):
        degree = hnsw.UPPER_DEGREE if at else hnsw.DEGREE
        out.append(np.stack([row[at : at + degree] for row in links[:size]]).astype(np.int32))
        at += degree
    return out


class Shard:
    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("node")
        self.ids, self.copies = frame["id"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64)
        self.exact, self.x = _units(frame)
        self.levels = _levels(frame)

    def _scans(self, queries: np.ndarray):
        """(first row, similarities to all nodes) of a few queries at a time."""
        step = max(1, SCAN_CELLS // len(self.x))
        for start in range(0, len(queries), step):
            yield start, queries[start : start + step] @ self.x.T

    def _full(self, queries: np.ndarray, least: float = MIN_COSINE - ROUNDING):
        """All (query, node) pairs of at least this similarity, by a scan."""
        none = np.zeros(0, np.int64)
        pairs = [(none, none)]
        for start, sims in self._scans(queries):
            at, node = np.nonzero(sims >= least)
            pairs.append((at + start, node))
        at, node = (np.concatenate(side) for side in zip(*pairs))
        return at, node

    def _beams(self, queries: np.ndarray, width: int):
        """(query, node) pairs that may be links, and the nodes of the beams."""
        entry = hnsw.descend(self.x, self.levels, queries, 0)
        ids, sims = hnsw.beam(self.x, self.levels[0], queries, entry, width)
        close = sims >= MIN_COSINE - ROUNDING
        full = close.sum(1) > width // 2  # there may be more
        at, column = np.nonzero(close & ~full[:, None])
        rows = np.flatnonzero(full)
        asked, node = self._full(queries[rows])
        return np.concatenate([at, rows[asked]]), np.concatenate([ids[at, column], node]).astype(np.int64), ids

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Some nodes, and for each a vector at a cosine of MIN_COSINE; the same ones at every attempt."""
        rng = np.random.default_rng(len(self.x))
        node = rng.choice(len(self.x), min(PROBES, len(self.x)), replace=False)
        aim = self.x[node].astype(np.float64)
        away = rng.normal(size=aim.shape)
        away -= np.einsum("bd,bd->b", away, aim)[:, None] * aim
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        return node, (MIN_COSINE * aim + np.sqrt(1 - MIN_COSINE**2) * away).astype(np.float32)

    def audit(self, queries: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(width, links, links found, probes, probes found) for every width."""
        at, node = self._full(queries, MIN_COSINE + ROUNDING)
        rows = np.unique(at)
        true = set(zip(at.tolist(), node.tolist()))
        target, probes = self.probes()
        out = []
        for width in WIDTHS:
            asked, found, _ = self._beams(queries[rows], width)
            links = len(true.intersection(zip(rows[asked].tolist(), found.tolist())))
            entry = hnsw.descend(self.x, self.levels, probes, 0)
            ids, sims = hnsw.beam(self.x, self.levels[0], probes, entry, width)
            crowded = (sims >= MIN_COSINE - ROUNDING).sum(1) > width // 2  # would be scanned
            hits = int(((ids == target[:, None]).any(1) | crowded).sum())
            out.append((width, len(true), links, len(target), hits))
            if links == len(true) and hits == len(target):  # so are the wider ones
                out += [(wider, *out[-1][1:]) for wider in WIDTHS if wider > width]
                break
        return out

    def links(self, queries: np.ndarray, exact: np.ndarray, width: int | None):
        """(query, node) pairs whose cosine is at least MIN_COSINE; without a width by a scan."""
        at, node = self._beams(queries, width)[:2] if width else self._full(queries)
        keep = []
        for start in range(0, len(at), 1 << 16):
            a, b = at[start : start + (1 << 16)], node[start : start + (1 << 16)]
            keep.append(np.einsum("bd,bd->b", exact[a], self.exact[b]) >= MIN_COSINE)
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        return at[keep], node[keep]


def audit_block(queries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Rows of AUDIT: what the beams of each width find for the audited queries of a block."""
    columns = [column.split()[0] for column in AUDIT.split(", ")]
    if not len(nodes):
        return pd.DataFrame(columns=columns).astype("int64")
    shard = Shard(nodes)
    found = shard.audit(_units(queries)[1] if len(queries) else shard.x[:0])
    cell = (int(nodes["dim"].iloc[0]), int(nodes["shard"].iloc[0]))
    return pd.DataFrame([(*cell, *row) for row in found], columns=columns).astype("int64")


def search_block(queries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Rows of FOUND: links of the classes that have few, numbers and forest edges of the others."""
    columns = {"kind": "object", "a": "Int64", "b": "Int64", "n": "Int64"}
    none = pd.DataFrame({name: [] for name in columns}).astype(columns)
    if not len(queries) or not len(nodes):
        return none
    shard, (exact, x) = Shard(nodes), _units(queries)
    ids = queries["id"].to_numpy(np.int64)
    width = nodes["width"].iloc[0]
    at, node = shard.links(x, exact, None if pd.isna(width) else int(width))
    other = ids[at] != shard.ids[node]
    at, node = at[other], node[other]
    few = (np.bincount(at, minlength=len(ids)) <= FEW)[at]
    asked, place = np.unique(at[~few], return_inverse=True)
    counts = np.bincount(place, shard.copies[node[~few]]).astype(np.int64)
    left, right = forest(ids[at[~few]], shard.ids[node[~few]])
    parts = [
        {"kind": "link", "a": ids[at[few]], "b": shard.ids[node[few]], "n": pd.NA},
        {"kind": "number", "a": ids[asked], "b": nodes["shard"].iloc[0], "n": counts},
        {"kind": "edge", "a": left, "b": right, "n": pd.NA},
    ]
    frames = [pd.DataFrame(part, index=range(len(part["a"]))).astype(columns) for part in parts]
    return pd.concat([none, *frames], ignore_index=True)


def _cell(column: str, count: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")


def _every(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def graphs_of(classes: DataFrame, shards: int) -> DataFrame:
    """NODES of all shards."""
    dealt = classes.withColumn("shard", _cell("id", shards)).select("dim", "shard", "id", "copies", "embedding")
    return written(dealt.repartition(4 * shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(build_shard, NODES), "graphs")


def widths_of(classes: DataFrame, graphs: DataFrame, shards: int, n: int) -> DataFrame:
    """(dim, shard, width) of every shard: the narrowest beam that passed the audit, null where none did."""
    cell = ["dim", "shard", "block"]
    rounds = max(1, -(-n // (AUDIT_EVERY * BLOCK_QUERIES)))  # the audited queries in blocks of their own
    audited = classes.where(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(AUDIT_EVERY)) == 0)
    block = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(rounds)).cast("int")
    audited = audited.select("dim", "id", "embedding", block.alias("block"), _every(shards).alias("shard"))
    probed, tasks = graphs.withColumn("block", _every(rounds)), 4 * shards * rounds
    audits = (
        audited.repartition(tasks, *cell).groupBy(*cell).cogroup(probed.repartition(tasks, *cell).groupBy(*cell))
        .applyInPandas(audit_block, AUDIT)
    )
    sums = audits.groupBy("dim", "shard", "width").agg(
        *[F.sum(c).alias(c) for c in ("links", "links_found", "probes", "probes_found")]
    )
    passed = (F.col("links_found") >= LINK_RECALL * F.col("links")) & (F.col("probes_found") >= PROBE_RECALL * F.col("probes"))
    widths = written(sums.groupBy("dim", "shard").agg(F.min(F.when(passed, F.col("width"))).alias("width")), "widths")
    used = {row["width"]: row["count"] for row in widths.groupBy("width").count().collect()}  # one row a width
    logging.getLogger(__name__).info("shards by width of their beams (None: scanned): %s", used)
    return widths


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    members, classes = classes_of(vectors)
    n = classes.count()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD_VECTORS)), max(2, -(-n // BLOCK_QUERIES))
    graphs = graphs_of(classes, shards)
    cell, tasks = ["dim", "shard", "block"], 2 * shards * blocks
    block = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int")
    asked = classes.select("dim", "id", "embedding", block.alias("block"), _every(shards).alias("shard"))
    widths = widths_of(classes, graphs, shards, n)
    held = graphs.join(widths, ["dim", "shard"], "left").withColumn("block", _every(blocks))
    found = written(
        asked.repartition(tasks, *cell).groupBy(*cell).cogroup(held.repartition(tasks, *cell).groupBy(*cell))
        .applyInPandas(search_block, FOUND),
        "found",
    )
    links = found.where("kind = 'link'").select("a", "b")
    links = links.union(links.select("b", "a")).distinct()  # found from either side
    numbers = found.where("kind = 'number'").select("a", F.col("b").cast("int").alias("shard"), "n")
    own = links.withColumn("shard", _cell("b", shards)).join(numbers, ["a", "shard"], "left_anti")
    copies = classes.select(F.col("id").alias("b"), F.col("copies").alias("n"))
    counts = own.join(copies, "b").select("a", "n").union(numbers.select("a", "n"))
    counts = counts.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    united = components(links.union(found.where("kind = 'edge'").select("a", "b")))
    rows = vectors.where("vec_id IS NOT NULL").select("vec_id").distinct()
    joined = rows.join(members, "vec_id", "left").join(counts, "id", "left").join(united, "id", "left")
    component = F.coalesce("component", "id", "vec_id")
    n_links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return joined.select(
        "vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"),
    )


def query(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), united AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = u.vec_id) AS n_links, component_id,
       vec_id = component_id AS kept
FROM united u
"""
