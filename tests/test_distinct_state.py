"""Distinct counts from merged bitmaps against direct counts, for any subset of snapshots."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from forgelens.operators import distinct_state

DAYS = ["2026-01-01", "2026-01-08", "2026-01-15", "2026-01-22"]


@pytest.fixture(scope="module")
def held(spark):
    rng = random.Random(8)
    rows = [
        (day, metric, f"owner/{i:05d}")
        for day in DAYS for metric in ("repos", "a", "b") for i in rng.sample(range(400), 60 if metric == "b" else 150)
    ]
    rows += rows[:50] + [(DAYS[0], "a", None)]
    df = spark.createDataFrame(rows, "snapshot string, metric string, repo string")
    first = distinct_state.with_new_repos(spark.createDataFrame([], distinct_state.NUMBERS), df.where(F.col("snapshot") <= DAYS[1]))
    # numbers start high, so that several buckets are used
    first = first.withColumn("number", F.col("number") * 601)
    numbers = distinct_state.with_new_repos(first, df)
    state = spark.createDataFrame(distinct_state.state_of(df, numbers).collect(), "snapshot string, metric string, bucket bigint, bits binary")
    return {row for row in rows if row[2]}, state, numbers


def test_numbers_are_kept_and_dense(spark, held):
    rows, _, numbers = held
    found = {row.repo: row.number for row in numbers.collect()}
    early = sorted({repo for day, _, repo in rows if day <= DAYS[1]})
    late = sorted({repo for *_, repo in rows} - set(early))
    assert found == {repo: 601 * i for i, repo in enumerate(early)} | {repo: 601 * (len(early) - 1) + 1 + i for i, repo in enumerate(late)}


def test_unions_of_any_snapshots(held):
    rows, state, _ = held
    assert state.select("bucket").distinct().count() > 3
    for size in (1, 2, 4):
        for days in itertools.combinations(DAYS, size):
            got = {row.metric: row.repos for row in distinct_state.union_counts(state.where(F.col("snapshot").isin(*days))).collect()}
            assert got == {m: len({repo for day, metric, repo in rows if metric == m and day in days}) for m in ("repos", "a", "b")}


def test_cumulative_and_shared(held):
    rows, state, _ = held
    of = lambda metric, *days: {repo for day, m, repo in rows if m == metric and day in days}
    got = {(row.snapshot, row.metric): row.repos for row in distinct_state.cumulative_counts(state).collect()}
    assert got == {(day, m): len(of(m, *DAYS[: i + 1])) for i, day in enumerate(DAYS) for m in ("repos", "a", "b")}
    shared = {(row.snapshot, row.metric): row.repos for row in distinct_state.shared_counts(state).collect()}
    expected = {
        (day, m): len(of(m, day) & of("repos", day) & of("repos", before)) for before, day in zip(DAYS, DAYS[1:]) for m in ("repos", "a", "b")
    }
    assert shared == {key: n for key, n in expected.items() if n}
