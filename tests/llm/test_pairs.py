"""Near duplicates of texts and vectors, and components, against brute force."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from forgelens.llm import embedding_dedup, near_dedup
from forgelens.llm.components import components, forest
from tests.llm.helpers import documents, smallest_reachable, words


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    df = spark.createDataFrame(links, "a long, b long")
    expected = smallest_reachable({x for pair in links for x in pair}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {row.id: row.component for row in components(df).collect()} == {x: expected[x] for x in linked}
    assert components(df.limit(0)).count() == 0
    a, b = (np.array(side) for side in zip(*links))
    assert smallest_reachable(expected, zip(*map(list, forest(a, b)))) == expected


def shingle_set(text, n):
    found = text.encode().lower().split() if text else []
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1)))


def expected_components(texts, n):
    sets = {i: shingle_set(text, n) for i, text in texts.items()}
    links = [
        (i, j)
        for i, j in itertools.combinations(texts, 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    return sets, smallest_reachable(texts, links)


@pytest.fixture(scope="module")
def near_texts():
    """Groups of near copies, one of them longer than a long list, with some copies far from the others."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [words(rng, 60, vocabulary) for _ in range(40)]
    base = words(rng, 90, vocabulary).split()
    for edits in [1, 2, 3, 4, 6, 9, 12] * 10:
        copy = list(base)
        for at in rng.sample(range(90), edits):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), " ".join(base[:80]), None, "", " \t\n", "one", "One", "one two", "the of", "the  of\n"]
    return dict(enumerate(texts))


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, near_texts, n):
    rows = near_dedup.near_duplicates(documents(spark, list(near_texts.values())), words=n).collect()
    sets, expected = expected_components(near_texts, n)
    assert {row.doc_id: (row.n_shingles, row.component_id, row.kept) for row in rows} == {
        i: (len(sets[i]), expected[i], expected[i] == i) for i in near_texts
    }
    assert len(rows) == len(near_texts) and len(set(expected.values())) < 110


def test_texts_are_compared_in_blocks(spark, near_texts, monkeypatch):
    monkeypatch.setattr(near_dedup, "LONG_LIST", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 8)
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    rows = near_dedup.near_duplicates(documents(spark, list(near_texts.values())), words=2).collect()
    assert {row.doc_id: row.component_id for row in rows} == expected_components(near_texts, 2)[1]


def test_repeated_and_absent_ids(spark):
    long = " ".join(f"a{i}" for i in range(30))
    docs = documents(spark, [long, long, long + " more", "else " * 3], ids=[4, 4, 2, None])
    rows = near_dedup.near_duplicates(docs, words=2).collect()
    assert sorted((row.doc_id, row.component_id, row.kept) for row in rows if row.doc_id) == [
        (2, 2, True), (4, 2, False), (4, 2, False),
    ]
    assert [(row.component_id, row.kept) for row in rows if row.doc_id is None] == [(None, True)]
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and {row.doc_id for row in kept.collect()} == {2, None}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long")


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16))
    near = base[:30] + 0.05 * rng.normal(size=(30, 16))
    group = base[5] + 0.1 * rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in v], 0, 1) for i, v in enumerate(np.concatenate([base, near, group]))]
    bad = [None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(1000 + i, v, 0, 1) for i, v in enumerate(bad)]
    rows += [(2000, rows[3][1], 0, 1), (2000, rows[3][1], 1, 1), (2001, [2 * x for x in rows[4][1]], 0, 1), (None, rows[3][1], 0, 1)]
    valid = {i: np.float32(v).astype(float) for i, v, *_ in rows if i is not None and (i < 1000 or i >= 2000)}
    links = [
        (i, j) for i, j in itertools.combinations(valid, 2)
        if valid[i] @ valid[j] / math.sqrt((valid[i] @ valid[i]) * (valid[j] @ valid[j])) >= 0.95
    ]
    expected = smallest_reachable({i for i, *_ in rows if i is not None}, links)
    got = {row.vec_id: row for row in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert {i: row.component_id for i, row in got.items()} == expected
    assert {i: row.n_links for i, row in got.items()} == {i: sum(i in pair for pair in links) for i in expected}
    assert all(row.kept == (row.component_id == i) for i, row in got.items())
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_rare_links_are_not_lost_by_narrow_beams(spark, monkeypatch):
    """A poor graph, one shard, few links: hardly any audited query has one."""
    from forgelens.llm import hnsw

    monkeypatch.setattr(hnsw, "DEGREE", 4)
    monkeypatch.setattr(hnsw, "BUILD_BEAM", 4)
    monkeypatch.setattr(embedding_dedup, "LEAST_SHARDS", 1)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(4200, 32))
    near = base[:24] + 0.2 * rng.normal(size=(24, 32))
    group = base[50] + 0.12 * rng.normal(size=(30, 32))
    x = np.concatenate([base, near, group]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    expected = (unit @ unit.T >= 0.95).sum(1) - 1
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]
    got = {row.vec_id: row.n_links for row in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert expected[:24].sum() > 10 and got == dict(enumerate(expected.tolist()))


def test_audit_has_power_without_links(monkeypatch):
    """Probes tell a poor graph from a good one where no audited query has a link."""
    from forgelens.llm import hnsw

    rng = np.random.default_rng(7)
    x = rng.normal(size=(5000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def audit():
        shard = embedding_dedup.Shard.__new__(embedding_dedup.Shard)
        shard.x, shard.levels = x[:4500], hnsw.build(x[:4500])
        return shard.audit(x[4500:])

    good = audit()
    assert [row[0] for row in good] == list(embedding_dedup.WIDTHS) and all(row[1:4] == (0, 0, 512) for row in good)
    assert good[1][4] >= 0.995 * 512
    monkeypatch.setattr(hnsw, "DEGREE", 3)
    monkeypatch.setattr(hnsw, "BUILD_BEAM", 3)
    assert audit()[0][4] < 0.9 * 512


def test_probes_are_at_the_threshold():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = embedding_dedup.Shard.__new__(embedding_dedup.Shard)
    shard.x = x
    node, probes = shard.probes()
    assert len(set(node.tolist())) == 300
    assert np.allclose(np.einsum("bd,bd->b", probes, x[node]), 0.95, atol=1e-5)


def test_rows_come_from_the_graphs(spark, monkeypatch):
    """15,000 vectors: no shard is scanned, few queries are, and the links are those of brute force."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(14_000, 64))
    near = base[:700] + 0.2 * rng.normal(size=(700, 64))
    group = base[900] + 0.12 * rng.normal(size=(300, 64))
    x = np.concatenate([base, near, group]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    expected = np.concatenate([(unit[at : at + 1000] @ unit.T >= 0.95).sum(1) - 1 for at in range(0, 15_000, 1000)])
    seen = []
    original = embedding_dedup.widths_of
    monkeypatch.setattr(embedding_dedup, "widths_of", lambda *args: seen.append(original(*args)) or seen[-1])
    df = spark.createDataFrame(
        pd.DataFrame({"vec_id": range(len(x)), "embedding": list(x)}), "vec_id long, embedding array<float>"
    )
    got = {row.vec_id: row.n_links for row in embedding_dedup.near_duplicates(df).collect()}
    widths = [row.width for row in seen[0].collect()]
    assert len(widths) == embedding_dedup.LEAST_SHARDS and None not in widths and max(widths) <= 64
    right = sum(got[i] == n for i, n in enumerate(expected.tolist()) if n)
    assert all(got[i] <= n for i, n in enumerate(expected.tolist()))  # none below the threshold
    assert (expected > 0).sum() > 1500 and right >= 0.995 * (expected > 0).sum()


def test_graph_finds_what_a_scan_finds():
    from forgelens.llm import hnsw

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[700:760] = x[3] + 0.02 * rng.normal(size=(60, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    levels = hnsw.build(x)
    assert [len(level) for level in levels] == hnsw.level_sizes(1500) and len(levels) == 2
    ids, _ = hnsw.beam(x, levels[0], x[:300], hnsw.descend(x, levels, x[:300], 0), 64)
    true = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(np.intersect1d(a, b)) / 10 for a, b in zip(true, ids)]) > 0.9
