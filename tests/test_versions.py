"""Keyed state of file versions: replays, other splits and late observations give what one batch gives."""

import datetime
import random

import pytest

from forgelens.streaming import versions

START = datetime.datetime(2026, 1, 1)
FLOW = "on: {trigger}\njobs:\n  one:\n    runs-on: ubuntu-latest\n    steps:\n      - run: make\n"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def observations(seed, count=160):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        content = rng.choice([None, "", ": [", *[FLOW.format(trigger=t) for t in ("push", "pull_request", "schedule")]])
        at = START + datetime.timedelta(minutes=rng.randrange(40))  # ties
        rows.append((f"o/r{rng.randrange(4)}", f"f{rng.randrange(5)}.yml", "raw", content, at))
    return rows + [("o/r0", "f0.yml", "raw", "untimed", None)]


def take_in(spark, root, batches):
    landing, tables = f"{root}/landing", f"{root}/tables"
    for batch in batches:
        spark.createDataFrame(batch, versions.OBSERVATION).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(versions.OBSERVATION).parquet(landing)
        versions.start(stream, tables, f"{root}/checkpoint").awaitTermination()
    return tables


def state(spark, tables):
    return {(row.repo, row.file_name): row.sha for row in versions.current(spark, tables).collect()}


def test_replays_and_splits_equal_one_batch(spark, tmp_path):
    rows = observations(1)
    whole = spark.createDataFrame(rows, versions.OBSERVATION)
    expected = {(row.repo, row.file_name): row.sha for row in versions.newest(whole).collect()}
    assert len(expected) > 8
    provider = spark.conf.get(versions.PROVIDER)
    twice = take_in(spark, tmp_path / "a", [rows[:90], rows[90:], rows[:90]])
    split = take_in(spark, tmp_path / "b", [rows[1::2], rows[::2]])
    assert state(spark, twice) == state(spark, split) == expected
    assert spark.conf.get(versions.PROVIDER) == provider
    assert spark.read.parquet(f"{twice}/versions/run=2").count() == 0  # nothing is newer
    triggers = [
        {(row.repo, row.workflow_path, *row.triggers) for row in versions.workflows(spark, tables).collect()}
        for tables in (twice, split)
    ]
    assert triggers[0] == triggers[1] and 0 < len(triggers[0]) < len(expected)


def test_outcomes(spark, tmp_path):
    at = [START + datetime.timedelta(hours=i) for i in range(4)]
    row = lambda content, when: [("o/r", "ci.yml", "raw", content, when)]
    push = FLOW.format(trigger="push")
    steps = [row(push, at[0]), row(push, at[2]), row("late", at[1]), row(None, at[3])]
    tables = take_in(spark, tmp_path, steps)
    log = spark.read.parquet(f"{tables}/versions").orderBy("run").collect()
    assert [(r.run, r.outcome, r.seen_at) for r in log] == [(0, "new", at[0]), (3, "removed", at[3])]
    assert state(spark, tables) == {} and versions.workflows(spark, tables).count() == 0
