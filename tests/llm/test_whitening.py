"""Whitening against exact rational arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from forgelens.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string, n string, x string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "a", "b", "c") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def expected(vectors):
    """x of every row, n, S and the exact covariance of the distinct ones."""
    length = max(map(len, vectors))
    whole = [tuple(int(np.floor(256 * float(c))) for c in v) + (0,) * (length - len(v)) for v in vectors]
    fit = sorted(set(whole))
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    cov = [[Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n**3) for j in range(length)] for i in range(length)]
    return whole, n, sums, np.array(cov, dtype=object).astype(np.float64)


def check(rows, vectors, ids=None):
    whole, n, sums, cov = expected(vectors)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1].T
    count = min(4, len(values))
    assert len(rows) == len(vectors) * count
    by_row = {(row.vec_id, row.component): row for row in rows}
    ids = range(len(vectors)) if ids is None else ids
    signs = {}
    for i, x in zip(ids, whole):
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(count):
            row = by_row[i, k + 1]
            assert (row.n, row.deviation, row.deviation_exact) == (n, deviation if deviation < 2**63 else None, str(deviation))
            assert row.explained == pytest.approx(values[k] / np.trace(cov), rel=1e-9) if np.trace(cov) else row.explained == 0
            if values[k] <= 1e-12 * values[0] or values[0] <= 0:
                assert row.whitened is None
                continue
            value = float((np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) @ basis[k]) / np.sqrt(values[k]))
            if abs(value) > 1e-6:
                signs.setdefault(k, np.sign(value * row.whitened))
                assert row.whitened == pytest.approx(signs[k] * value, rel=1e-6, abs=1e-6)
    assert {row.identity_error for row in rows} and all(0 <= row.identity_error < 1e-8 for row in rows)


def test_against_exact_arithmetic(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 7)) @ np.diag([5, 3, 2, 1.5, 1, 0.5, 0.25]) + 0.3
    vectors = [*base, *[base[3]] * 150, -0.0 * base[0]]
    rows = whitening.whiten(table(spark, vectors)).collect()
    check(rows, vectors)
    white = np.array([[r.whitened for r in rows if r.component == k and r.vec_id < 300] + [r.whitened for r in rows if r.component == k and r.vec_id == 450] for k in (1, 2, 3, 4)])
    assert np.abs(np.cov(white, bias=True) - np.eye(4)).max() < 1e-8


def test_large_values_take_limbs_and_python_integers(spark):
    rng = np.random.default_rng(2)
    for scale in (1e6, 1e9, 1e14):
        vectors = list(rng.normal(size=(60, 3)) * scale)
        check(whitening.whiten(table(spark, vectors)).collect(), vectors)


def test_square_sums_are_exact():
    rng = np.random.default_rng(3)
    for bits in (5, 20, 30, 45, 61):
        y = rng.integers(-(1 << bits) + 1, 1 << bits, (2500, 3))
        wide = [[int(v) for v in row] for row in y]
        for (i, j), total in whitening.square_sums(y).items():
            assert total == sum((row[i] if i == j else row[i] + row[j]) ** 2 for row in wide)


def test_polarisation_gives_cross_products():
    y = np.array([[3, -1], [-2, 5], [-1, -4]])
    got = whitening.covariance(whitening.square_sums(y), 3, 2)
    assert got.tolist() == [[14 / 27, (-3 - 10 + 4) / 27], [-9 / 27, 42 / 27]]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    sound = [[1.0, 2.0, 3.0], [1.0, 2.0], [0.5, 0.25, -1.0], [1.0, 2.0, 3.0], []]
    broken = [None, [None, 1.0, 1.0], [nan, 1.0, 1.0], [inf, 0.0, 0.0]]
    rows = whitening.whiten(table(spark, sound + broken)).collect()
    check(rows, sound)  # 4 distinct vectors in 3 dimensions, short ones filled up
    same = whitening.whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    check(same, [[1.0, 2.0]] * 3)
    repeated = whitening.whiten(table(spark, sound[:3], ids=[5, 5, None])).collect()
    assert sorted((str(row.vec_id), row.component) for row in repeated) == sorted((i, k) for i in ("5", "5", "None") for k in (1, 2, 3))
    assert whitening.whiten(table(spark, broken)).count() == 0
    assert whitening.whiten(table(spark, sound).limit(0)).count() == 0
    huge = whitening.whiten(table(spark, [[1e300, 0.0], [-1e300, 1.0]])).collect()
    assert {row.deviation for row in huge} == {None} and all(row.explained is not None for row in huge)


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(whitening.query(spark, sf_dir).collect(), [row.embedding for row in table], [row.vec_id for row in table])
