"""Approximate nearest neighbours over balanced posting lists.

Equal vectors are one class, which keeps its k + 1 smallest ids: no query needs more of them.  2 * sqrt(n) centroids are
fitted to a sample (64 vectors a centroid, so it grows with the square root of the table as well): they start at
vectors drawn by a hash, which follow the density, move in ``ROUNDS`` rounds of means, and in each round a list that is
larger than ``BALANCE`` times the mean gives way to as many of its own members as it is too large.

Every class is posted to its nearest list and, where it lies at a boundary, to others: all whose centroid is at most
``CLOSURE`` times as far, ``REPLICAS`` in total.  Lists are packed into bins of about ``BIN_ROWS`` postings; a list that
is still larger is cut in parts, so a task's group is bounded whatever the data.

Centroids are searched by an in-memory graph (nearest centroids that are not occluded by nearer ones, both directions, and
a ring that keeps it connected).  A query walks all centroids within a ratio of the distance to the nearest one, and these
are the lists it reads.  The ratio is measured, not given: for ``AUDITED`` queries the true neighbours are found by brute
force in one distributed pass, and the smallest ratio is taken whose lists hold ``RECALL`` of them.  Distances are
taken on the original vectors in double precision.  Bins meet their queries in blocks of ``BLOCK_QUERIES``.

What the driver holds and sends to tasks are the centroids, their graph (about 130 bytes and a vector each) and two
numbers a bin or list: for a billion different vectors of 64 components 63,246 centroids, 40 MB.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
vec_id, take no part; rows that repeat a vec_id are one vector, the least by its components; shorter vectors count as filled
up with zeros; distances beyond doubles are infinite; a query with fewer than k other vectors returns all; an empty
table gives an empty table.  Only the id and the vector are read, so other columns cannot clash.
"""

import logging
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K, QUERY_EVERY = 10, 100
LISTS_PER_ROOT, SAMPLE_PER_LIST, ROUNDS, BALANCE = 2, 64, 3, 2.0
CLOSURE, REPLICAS = 1.08, 3
BIN_ROWS, BLOCK_QUERIES, MEMBERS_PER_SALT = 8192, 2048, 4096
AUDITED, RECALL = 128, 0.97
FURTHEST = 64.0  # a ratio beyond it reads every list
NEAR, DEGREE, LINKS = 48, 16, 32
WALK = 1.15  # a walk also steps on centroids so much farther than it selects
CELLS = 1 << 19  # (query, centroid) pairs that a step of a search holds
PAIR_BYTES = 1 << 23  # of the vectors that are subtracted at once


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a list column as rows in double precision, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = values
    return out


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(np.square(vectors - query).sum(axis=1))


class Centroids:
    """Centroids and their graph."""

    def __init__(self, centres: np.ndarray, spread: float = 0.0):
        self.centres, self.spread = centres, spread  # spread: least distance that ratios refer to
        self.squares = np.square(centres).sum(axis=1)
        self.pivots = np.arange(0, len(centres), max(1, math.isqrt(len(centres))))
        self.links = self._graph()

    def _graph(self) -> np.ndarray:
        n = len(self.centres)
        sources, targets, weights = [], [], []
        near = min(NEAR, n - 1)
        for at in range(0, n if near else 0, 1024):
            rows = np.arange(at, min(at + 1024, n))
            far = self.squares[rows, None] + self.squares[None, :] - 2 * self.centres[rows] @ self.centres.T
            far[np.arange(len(rows)), rows] = np.inf
            ids = np.argpartition(far, near - 1, axis=1)[:, :near]
            ids = np.take_along_axis(ids, np.argsort(np.take_along_axis(far, ids, 1), axis=1, kind="stable"), 1)
            mine = np.take_along_axis(far, ids, 1)
            held = self.centres[ids]
            between = self.squares[ids][:, :, None] + self.squares[ids][:, None, :] - 2 * held @ held.transpose(0, 2, 1)
            chosen, occluded = np.zeros(ids.shape, bool), np.full(ids.shape, np.inf)
            for j in range(near):
                take = (mine[:, j] < occluded[:, j]) & (chosen.sum(1) < DEGREE)
                chosen[:, j] = take
                occluded = np.where(take[:, None], np.minimum(occluded, between[:, j]), occluded)
            row, column = np.nonzero(chosen)
            sources.append(rows[row]), targets.append(ids[row, column]), weights.append(mine[row, column])
        ring = np.arange(n)
        if not sources:
            return np.full((n, 1), -1, np.int32)
        a, b, w = np.concatenate(sources), np.concatenate(targets), np.concatenate(weights)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((np.concatenate([w, w]), a))
        a, b = a[order], b[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        links = np.full((n, LINKS + 1), -1, np.int32)
        links[a[place < LINKS], place[place < LINKS]] = b[place < LINKS]
        links[:, LINKS] = (ring + 1) % n
        return links

    def near(self, queries: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, centroid, distance) of the centroids within ``ratio`` times the distance of the nearest one."""
        step = max(1, CELLS // len(self.centres))
        found = [self._near(queries[at : at + step], ratio, at) for at in range(0, len(queries), step)]
        return tuple(np.concatenate(parts) for parts in zip(*found)) if found else (np.zeros(0, int),) * 2 + (np.zeros(0),)

    def read(self, queries: np.ndarray, ratio: float, homes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list): the lists within ``ratio``; a query whose lists hold fewer than ``least`` classes looks further."""
        row, lists, _ = self.near(queries, ratio)
        while True:
            held = np.bincount(row, weights=homes[lists], minlength=len(queries))
            few = np.flatnonzero(held < min(least, homes.sum()))
            if not len(few):
                return row, lists
            ratio *= 1.25
            more, further, _ = self.near(queries[few], ratio)
            others = ~np.isin(row, few)
            row, lists = np.concatenate([row[others], few[more]]), np.concatenate([lists[others], further])

    def _near(self, queries, ratio, first):
        n, size = len(queries), len(self.centres)
        own = np.square(queries).sum(axis=1)
        far = np.full((n, size), np.inf)
        far[:, self.pivots] = self._root(own[:, None] + self.squares[self.pivots] - 2 * queries @ self.centres[self.pivots].T)
        best = far.min(axis=1)
        expanded = np.zeros((n, size), bool)
        while True:
            row, centre = np.nonzero((far <= self._reach(best, WALK * ratio)[:, None]) & np.isfinite(far) & ~expanded)
            if not len(row):
                break
            expanded[row, centre] = True
            fresh = np.zeros((n, size), bool)
            for column in self.links.T:
                fresh[row, column[centre]] = True  # -1 marks the last centroid: harmless
            row, centre = np.nonzero(fresh & np.isinf(far))
            found = self._root(own[row] + self.squares[centre] - 2 * self._products(queries, row, centre))
            far[row, centre] = found
            np.minimum.at(best, row, found)
        row, centre = np.nonzero((far <= self._reach(best, ratio)[:, None]) & np.isfinite(far))
        return row + first, centre, far[row, centre]

    def _products(self, queries, row, centre):
        step = max(1, PAIR_BYTES // (8 * max(1, queries.shape[1])))
        parts = [
            np.einsum("pd,pd->p", queries[row[at : at + step]], self.centres[centre[at : at + step]])
            for at in range(0, len(row), step)
        ]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _reach(self, best, ratio):
        return np.full(len(best), np.inf) if ratio > FURTHEST else ratio * np.maximum(best, self.spread)

    @staticmethod
    def _root(squared):
        return np.sqrt(np.clip(np.nan_to_num(squared, nan=1e300, posinf=1e300), 0, 1e300))

    def lists_of(self, vectors: np.ndarray, closure: float, replicas: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) of every posting: the nearest lists within ``closure``."""
        row, centre, far = self.near(vectors, closure)
        order = np.lexsort((centre, far, row))
        row, centre = row[order], centre[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < replicas
        return row[keep], centre[keep]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): valid vectors, one a vec_id."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(sound)
    rows = rows.where(F.exists("embedding", lambda x: x != 0)).select("vec_id", F.col("embedding").alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(class, ids, v): different vectors with the k + 1 smallest of their ids, the first of which names the class."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    held = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return held.select(F.get("ids", F.lit(0)).alias("class"), "ids", "v")


def _by_hash(share: float, salt: str) -> Column:
    return F.pmod(F.xxhash64("class", F.lit(salt)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def _means(sample: DataFrame, centroids: Centroids, dims: int) -> dict[int, tuple[int, np.ndarray, float]]:
    """Size, mean and summed distance of the lists of a sample."""

    def partial(batches):
        totals = np.zeros((len(centroids.centres), dims + 2))
        for batch in batches:
            x = matrix(batch.column(0), dims)
            row, centre, far = centroids.near(x, 1.0)
            order = np.lexsort((centre, far, row))
            row, centre, far = row[order], centre[order], far[order]
            once = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
            np.add.at(totals, centre[once], np.column_stack([np.ones(once.sum()), far[once], x[row[once]]]))
        used = np.flatnonzero(totals[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(totals[used]), pa.list_(pa.float64()))], ["list", "sums"])

    def added(key, frame):
        return pd.DataFrame({"list": [key[0]], "sums": [np.sum(np.stack(frame["sums"].to_list()), axis=0)]})

    kind = "list long, sums array<double>"
    rows = sample.select("v").mapInArrow(partial, kind).groupBy("list").applyInPandas(added, kind).collect()  # one a list
    out = {}
    for row in rows:
        sums = np.array(row.sums)
        out[row.list] = (int(sums[0]), sums[2:] / sums[0], float(sums[1]))
    return out


def _picked(sample: DataFrame, centroids: Centroids, parts: dict[int, float], dims: int, turn: int) -> np.ndarray:
    """Members of the lists of ``parts``, each with the share given there, by a hash of their class."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), dims)
            row, centre = centroids.lists_of(x, 1.0, 1)
            share = np.array([parts.get(int(c), 0.0) for c in centre])
            hashed = batch.column(2).to_numpy()[row] / (1 << 30)
            yield batch.take(pa.array(row[hashed < share])).select(["v"])

    hashed = F.pmod(F.xxhash64("class", F.lit(f"part{turn}")), F.lit(1 << 30)).alias("hash")
    rows = sample.select("class", "v", hashed).mapInArrow(run, sample.select("v").schema).collect()  # about one a part
    out = np.zeros((len(rows), dims))
    for i, row in enumerate(rows):
        out[i, : len(row.v)] = row.v
    return out


def fit(classes: DataFrame, n: int, dims: int) -> Centroids:
    """Centroids for ``n`` classes."""
    lists = max(1, round(LISTS_PER_ROOT * math.sqrt(n)))
    share = min(1.0, SAMPLE_PER_LIST * lists / n)
    sample = classes if share == 1 else written(classes.where(_by_hash(share, "sample")), "sample")
    start = sample.orderBy(F.xxhash64("class", F.lit("start")), "class").limit(lists).select("v").collect()
    centres = np.zeros((len(start), dims))
    for i, row in enumerate(start):
        centres[i, : len(row.v)] = row.v
    centroids = Centroids(centres)
    for turn in range(ROUNDS):
        found = _means(sample, centroids, dims)
        size = sum(count for count, *_ in found.values())
        mean = size / len(found)
        large = {key: math.ceil(count / mean) / count for key, (count, *_) in found.items() if count > BALANCE * mean}
        centres = [centre for key, (_, centre, _) in sorted(found.items()) if key not in large]
        if large:
            members = _picked(sample, centroids, large, dims, turn)
            centres = [*centres, *members] or [found[key][1] for key in sorted(found)]
        spread = sum(far for *_, far in found.values()) / size
        centroids = Centroids(np.array(centres), spread)
    return centroids


def true_neighbours(classes: DataFrame, asked: np.ndarray, k: int, dims: int) -> DataFrame:
    """(query, vec, distance, v): the nearest k + 1 classes of a bounded set of vectors, by brute force."""

    def run(batches):
        for batch in batches:
            x, ids = matrix(batch.column(1), dims), batch.column(0).to_numpy()
            for i, query in enumerate(asked):
                far = distances(query, x)
                first = np.lexsort((ids, far))[: k + 1] if len(far) > k + 1 else np.arange(len(far))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), i)), batch.column(0).take(pa.array(first)), pa.array(far[first]),
                     batch.column(1).take(pa.array(first))],
                    names=["query", "vec", "distance", "v"],
                )

    vector = classes.schema["v"].dataType.simpleString()
    rows = classes.select("class", "v").mapInArrow(run, f"query long, vec long, distance double, v {vector}")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec"))
    return rows.withColumn("place", place).where(F.col("place") <= k + 1)


def audited_ratio(classes: DataFrame, asked: DataFrame, centroids: Centroids, k: int, dims: int) -> tuple[float, float]:
    """The ratio whose lists hold RECALL of the true neighbours of AUDITED queries, and the recall they give."""
    audit = asked.orderBy(F.xxhash64("class", F.lit("audit")), "class").limit(AUDITED).select("class", "v").collect()
    queries = np.zeros((len(audit), dims))
    for i, row in enumerate(audit):
        queries[i, : len(row.v)] = row.v
    hits = [row for row in true_neighbours(classes, queries, k, dims).collect() if row.vec != audit[row.query]["class"]]
    if not hits:
        return 1.0, 1.0
    vectors = np.zeros((len(hits), dims))
    for i, row in enumerate(hits):
        vectors[i, : len(row.v)] = row.v
    owner = np.array([row.query for row in hits])
    at, lists = centroids.lists_of(vectors, CLOSURE, REPLICAS)
    away = np.array([distances(queries[owner[i]], centroids.centres[c : c + 1])[0] for i, c in zip(at, lists)])
    nearest = np.array([distances(query, centroids.centres).min() for query in queries])
    needed = np.full(len(hits), FURTHEST)
    with np.errstate(divide="ignore", invalid="ignore"):
        np.fmin.at(needed, at, away / np.maximum(nearest, centroids.spread)[owner[at]])
    ratio = max(1.0, float(np.sort(needed)[math.ceil(RECALL * len(hits)) - 1])) * (1 + 1e-6)
    while True:
        row, centre, _ = centroids.near(queries, ratio)
        read = set(zip(row.tolist(), centre.tolist()))
        held = {i for i, c in zip(at, lists) if (owner[i], c) in read}
        recall = len(held) / len(hits)
        if recall >= RECALL or len(read) == len(queries) * len(centroids.centres):
            break
        ratio *= 1.02
    share = len(read) / (len(queries) * len(centroids.centres))
    logging.getLogger(__name__).info("ratio %.3f reads %.3f of the lists, recall %.3f", ratio, share, recall)
    return ratio, recall


class Bins:
    """Where the postings of a list lie: in one bin with others, or in several of its own."""

    def __init__(self, counts: np.ndarray):
        self.parts = np.maximum(1, -(-counts // BIN_ROWS))
        self.first = np.zeros(len(counts), np.int64)
        at, filled = 0, 0
        for i, (count, parts) in enumerate(zip(counts, self.parts)):
            if parts > 1 or filled + count > BIN_ROWS:
                at, filled = at + (filled > 0), 0
            self.first[i] = at
            at, filled = (at + parts, 0) if parts > 1 else (at, filled + count)


def search_cell(asks: pd.DataFrame, postings: pd.DataFrame, k: int, dims: int) -> pd.DataFrame:
    """The k + 1 nearest (vec_id, distance) of every query of a block among the lists that it reads in a bin."""
    empty = pd.DataFrame({"class": [], "vec_id": [], "distance": []}).astype({"class": "int64", "vec_id": "int64"})
    if not len(asks) or not len(postings):
        return empty
    fill = lambda held: matrix(pa.array(held.to_list()), dims)
    queries, vectors = fill(asks["v"]), fill(postings["v"])
    ids, lists = postings["ids"].to_numpy(), postings["list"].to_numpy()
    first_id = np.array([held[0] for held in ids])
    order = np.argsort(lists, kind="stable")
    starts = {key: (at, to) for key, at, to in zip(*_runs(lists[order]))}
    squares, own = np.square(vectors).sum(axis=1), np.square(queries).sum(axis=1)
    readers: dict[int, list[int]] = {}
    for i, wanted in enumerate(asks["lists"]):
        for key in wanted:
            readers.setdefault(key, []).append(i)
    hits: list[list[np.ndarray]] = [[] for _ in range(len(queries))]
    for key, (at, to) in starts.items():
        rows, who = order[at:to], readers.get(key, [])
        if not who:
            continue
        near = own[who, None] + squares[rows] - 2 * queries[who] @ vectors[rows].T
        kept = min(k, len(rows) - 1)
        bar = np.partition(near, kept, axis=1)[:, kept]
        slack = 1e-9 * (own[who] + squares[rows].max())
        for q, mask in zip(who, ~(near > (bar + slack)[:, None])):
            hits[q].append(rows[mask])
    out = []
    for q, found in enumerate(hits):
        if found:
            rows = np.unique(np.concatenate(found))
            far = distances(queries[q], vectors[rows])
            best = np.lexsort((first_id[rows], far))
            names, place = [], []
            seen: set[int] = set()
            for i in best:
                if first_id[rows[i]] in seen:
                    continue  # the same class from another list
                seen.add(first_id[rows[i]])
                names.extend(ids[rows[i]])
                place.extend([far[i]] * len(ids[rows[i]]))
                if len(seen) > k:
                    break
            top = np.lexsort((names, place))[: k + 1]
            out.append(pd.DataFrame({"class": asks["class"].iloc[q], "vec_id": np.array(names)[top], "distance": np.array(place)[top]}))
    return pd.concat(out, ignore_index=True) if out else empty


def _runs(values: np.ndarray):
    keys, first = np.unique(values, return_index=True)
    return keys, first, np.append(first[1:], len(values))


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for every query."""
    rows = written(usable(vectors), "vectors")
    classes = written(classes_of(rows, k), "classes")
    members = written(rows.where(is_query).join(classes.select("v", "class"), "v").select("vec_id", "class"), "members")
    held = members.groupBy("class").agg(F.count("*").alias("members"))
    asked = written(classes.join(held, "class").select("class", "v", "members"), "asked")
    n, dims = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    centroids = fit(classes, n, dims)
    ratio, _ = audited_ratio(classes, asked, centroids, k, dims)
    found = searched(classes, asked, centroids, ratio, k, dims)
    return _ranked(members, asked, found, k)


def posted(classes: DataFrame, centroids: Centroids, dims: int) -> DataFrame:
    """(list, home, hash, ids, v): the posting lists; ``home`` marks a class in its nearest one."""

    def post(batches):
        for batch in batches:
            row, lists = centroids.lists_of(matrix(batch.column(1), dims), CLOSURE, REPLICAS)
            taken = batch.take(pa.array(row))
            home = pa.array(np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool))
            columns = [pa.array(lists), home, taken.column(2), taken.column(0), taken.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "home", "hash", "ids", "v"])

    vector = classes.schema["v"].dataType.simpleString()
    hashed = F.pmod(F.xxhash64("class", F.lit("cell")), F.lit(1 << 30)).alias("hash")
    return classes.select("ids", "v", hashed).mapInArrow(post, f"list long, home boolean, hash long, ids array<long>, v {vector}")


def searched(classes: DataFrame, asked: DataFrame, centroids: Centroids, ratio: float, k: int, dims: int) -> DataFrame:
    """(class, vec_id, distance): the k + 1 best of every asked class."""
    vector = classes.schema["v"].dataType.simpleString()
    postings = written(posted(classes, centroids, dims), "postings")
    counts, homes = np.zeros((2, len(centroids.centres)), np.int64)
    for row in postings.groupBy("list").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).collect():  # one a list
        counts[row.list], homes[row.list] = row.n, row.homes
    bins = Bins(counts)
    first, parts = bins.first, bins.parts

    def ask(batches):
        for batch in batches:
            row, lists = centroids.read(matrix(batch.column(1), dims), ratio, homes, k + 1)
            row, lists = np.repeat(row, parts[lists]), np.repeat(lists, parts[lists])  # a list in parts: each of them
            cell = first[lists] + _within(row, lists)
            order = np.lexsort((lists, cell, row))
            row, lists, cell = row[order], lists[order], cell[order]
            starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])]) if len(row) else np.zeros(0, int)
            taken = batch.take(pa.array(row[starts]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[starts]), taken.column(0), taken.column(1),
                 pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(lists))],
                names=["bin", "class", "v", "lists"],
            )

    asks = written(asked.select("class", "v").mapInArrow(ask, f"bin long, class long, v {vector}, lists array<long>"), "asks")
    blocks = asks.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks"))
    place = asks.sparkSession.createDataFrame(
        pd.DataFrame({"list": np.arange(len(first)), "first": first, "parts": parts}), "list long, first long, parts long"
    )
    dealt = postings.join(place, "list").withColumn("bin", F.col("first") + F.col("hash") % F.col("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    left = asks.join(blocks, "bin").select("bin", F.pmod(F.xxhash64("class"), "blocks").alias("block"), "class", "v", "lists")
    right = dealt.join(blocks, "bin").select("bin", every, "list", "ids", "v")
    found = left.groupBy("bin", "block").cogroup(right.groupBy("bin", "block")).applyInPandas(
        lambda a, b: search_cell(a, b, k, dims), "class long, vec_id long, distance double"
    )
    once = found.groupBy("class", "vec_id").agg(F.min("distance").alias("distance"))
    best = F.row_number().over(Window.partitionBy("class").orderBy("distance", "vec_id"))
    return once.withColumn("place", best).where(F.col("place") <= k + 1).drop("place")


def _within(row: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of equal (row, list)."""
    if not len(row):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (lists[1:] != lists[:-1])])
    return np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))


def _ranked(members: DataFrame, asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """What each query gets from its class: all but itself, the first k.  Classes with many queries are salted."""
    salts = F.ceil(F.col("members") / MEMBERS_PER_SALT)
    hits = F.sort_array(F.collect_list(F.struct("distance", "vec_id"))).alias("hits")
    spread = found.groupBy("class").agg(hits).join(asked.select("class", salts.alias("salts")), "class")
    salted = spread.select("class", "salts", F.explode(F.sequence(F.lit(1).cast("bigint"), "salts")).alias("salt"), "hits")
    asking = members.join(asked.select("class", salts.alias("salts")), "class").select(
        F.col("vec_id").alias("query_id"), "class", (F.pmod(F.xxhash64("vec_id"), "salts") + 1).alias("salt")
    )
    others = F.slice(F.filter("hits", lambda hit: hit.vec_id != F.col("query_id")), 1, k)
    return asking.join(salted.drop("salts"), ["class", "salt"]).select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", F.col("hit.distance").alias("score")
    )


def query(spark, sf_dir) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % QUERY_EVERY == 0)
