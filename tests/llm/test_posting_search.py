"""Posting-list search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgelens.llm import posting_search as search

SCHEMA = "vec_id long, embedding array<float>, rank string, score string, list string, class string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [
        (i if i is None else int(i), None if v is None else [None if c is None else float(c) for c in v], "a", "b", "c", "d")
        for i, v in zip(ids, vectors)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_query(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.query_id, {})[row["rank"]] = (row.vec_id, row.score)
    return out


def brute_force(vectors, ids, k, every):
    x, out = np.asarray(vectors, np.float32).astype(np.float64), {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            far = np.sqrt(np.square(x - x[q]).sum(axis=1))
            best = [i for i in np.lexsort((ids, far)) if i != q][:k]
            out[ids[q]] = {rank: (ids[i], far[i]) for rank, i in enumerate(best, 1)}
    return out


def recall(got, expected):
    assert set(got) == set(expected)
    hits = 0
    for q, places in expected.items():
        assert sorted(got[q]) == sorted(places)
        scores = [got[q][rank][1] for rank in sorted(got[q])]
        assert scores == sorted(scores)
        wanted = dict(places.values())
        for vec_id, score in got[q].values():
            if vec_id in wanted:
                hits += 1
                assert score == pytest.approx(wanted[vec_id], rel=1e-12, abs=1e-12)
    return hits / sum(map(len, expected.values()))


def test_recall_on_clusters_and_noise(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    vectors = np.concatenate([centres[rng.integers(0, 40, 2400)] + 0.2 * rng.normal(size=(2400, 24)), rng.normal(size=(1200, 24))])
    ids = rng.permutation(len(vectors))
    got = by_query(search.nearest(table(spark, vectors, ids), F.col("vec_id") % 20 == 0))
    assert recall(got, brute_force(vectors, ids, 10, 20)) >= 0.9


def test_hot_copies_parts_and_blocks(spark, monkeypatch):
    """A third of all rows is one vector; bins, blocks and salts are small, so lists are cut and queries dealt."""
    for name, value in (("BIN_ROWS", 40), ("BLOCK_QUERIES", 3), ("MEMBERS_PER_SALT", 4)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(600, 8))
    near = base[0] + 1e-3 * rng.normal(size=(300, 8))
    vectors = np.concatenate([base, near, np.repeat(base[:1], 400, axis=0), base[5:25]])
    ids = rng.permutation(len(vectors))
    got = by_query(search.nearest(table(spark, vectors, ids), F.col("vec_id") % 10 == 0, k=4))
    expected = brute_force(vectors, ids, 4, 10)
    assert recall(got, expected) >= 0.9
    hot = {i for i, v in zip(ids, vectors) if (v == vectors[0]).all()}
    for q in hit_queries(expected, hot):
        assert got[q] == {rank: (i, 0.0) for rank, i in enumerate(sorted(hot - {q})[:4], 1)}


def hit_queries(expected, hot):
    found = [q for q in expected if q in hot]
    assert len(found) > 20
    return found


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 0], [0, 1], [1, 1], [1, 0, 0], None, [None, 1], [nan, 1], [inf, 1], [0, 0], [], [2, 2], [9, 9], [3, 3]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, None]
    df = table(spark, vectors, ids)
    got = by_query(search.nearest(df, F.lit(True), k=3))
    assert set(got) == {0, 1, 2, 3, 10}
    assert got[0] == {1: (3, 0.0), 2: (2, 1.0), 3: (1, 2**0.5)}  # [1, 0] and [1, 0, 0] are equal once filled up
    assert got[10] == {1: (2, 2**0.5), 2: (0, 5**0.5), 3: (1, 5**0.5)}  # the lesser of the two rows of id 10, a tie
    assert by_query(search.nearest(df.where("vec_id < 2"), F.lit(True))) == {0: {1: (1, 2**0.5)}, 1: {1: (0, 2**0.5)}}
    assert search.nearest(df.where("vec_id = 1"), F.lit(True)).count() == 0
    assert search.nearest(df.where("vec_id = 4"), F.lit(True)).count() == 0
    assert search.nearest(df.limit(0), F.lit(True)).count() == 0
    assert search.nearest(df, F.lit(False)).count() == 0


def test_graph_finds_the_centroids_within_a_ratio():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(500, 16))
    graph, queries = search.Centroids(centres), rng.normal(size=(80, 16))
    far = np.sqrt(np.square(queries[:, None] - centres[None]).sum(axis=2))
    row, centre, found = graph.near(queries, 1.15)
    true = set(zip(*np.nonzero(far <= 1.15 * far.min(axis=1)[:, None])))
    assert len(true & set(zip(row, centre))) >= 0.98 * len(true)
    assert np.allclose(found, far[row, centre])
    every = graph.near(queries, 1e9)
    assert len(every[0]) == 80 * 500  # the ring reaches all of them
    assert len(search.Centroids(centres[:1]).near(queries, 1.0)[0]) == 80


def test_lists_are_balanced_and_boundary_vectors_are_replicated(spark):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.normal(size=(1500, 6)), 5 + 0.01 * rng.normal(size=(1500, 6))])
    classes = search.classes_of(search.usable(table(spark, vectors)), 10).cache()
    centroids = search.fit(classes, 3000, 6)
    counts = [row["count"] for row in search.posted(classes, centroids, 6).groupBy("list").count().collect()]
    classes.unpersist()
    assert 3000 < sum(counts) <= 3 * 3000
    assert max(counts) <= 12 * sum(counts) / len(counts)
    bins = search.Bins(np.array([5, 20000, 3, 8190, 8192, 0, 1]))
    assert bins.parts.tolist() == [1, 3, 1, 1, 1, 1, 1] and bins.first.tolist() == [0, 1, 4, 5, 6, 6, 7]


def test_few_lists_are_read(spark):
    """With real clusters the ratio selects a small share of the lists."""
    rng = np.random.default_rng(5)
    centres = 10 * rng.normal(size=(60, 16))
    vectors = centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 16))
    classes = search.classes_of(search.usable(table(spark, vectors)), 10).cache()
    centroids = search.fit(classes, 3000, 16)
    asked = classes.where("class % 25 = 0")
    ratio, recall = search.audited_ratio(classes, asked, centroids, 10, 16)
    classes.unpersist()
    read = len(centroids.near(vectors[::25], ratio)[0])
    assert recall >= search.RECALL and read < 0.3 * len(vectors[::25]) * len(centroids.centres)
