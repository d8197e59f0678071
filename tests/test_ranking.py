"""Row numbers by ranges and offsets against sorting, under ties, nulls, long shared prefixes and hot groups."""

import random
import re

import pytest
from pyspark.sql import functions as F

from forgelens.functions import ranking

ORDERS = [
    [("score", True), ("name", False)],
    [("score", False), ("name", True)],
    [("name", True)],
    [("label", False), ("score", True), ("name", False)],
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [
        (
            rng.choice("aab") if rng.random() < 0.9 else None,
            rng.choice([None, 0.0, -1.5, 2.25, 1e300]),
            rng.choice(["x", "ÿ", "", None, 'q"u\\o\nte']),
            f"owner/{i:05d}",
        )
        for i in range(3000)
    ]
    return data, spark.createDataFrame(data, "grp string, score double, label string, name string")


def sort_key(order):
    names = ["grp", "score", "label", "name"]

    def less(row):
        out = []
        for column, descending in order:
            value = row[names.index(column)]
            present = value is not None
            if isinstance(value, str):
                number = [byte + 1 for byte in value.encode()] + [0] * (20 - len(value.encode()))
                out.append((-present, [-n for n in number]) if descending else (present, number))
            else:
                number = value if present else 0
                out.append((-present, -number) if descending else (present, number))
        return out

    return less


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("group", [(), ("grp",)])
@pytest.mark.parametrize("ranges", [1, 7, 512])
def test_numbers(rows, order, group, ranges):
    data, df = rows
    got = {row["name"]: row.place for row in ranking.numbered(df, order, "place", group, ranges).collect()}
    expected, counters = {}, {}
    for row in sorted(data, key=sort_key(order)):
        key = row[0] if group else "all"
        counters[key] = expected[row[3]] = counters.get(key, 0) + 1
    assert got == expected


def test_empty_table(spark):
    empty = spark.createDataFrame([], "name string")
    assert ranking.numbered(empty, [("name", False)], "place").count() == 0


def test_long_shared_prefixes_are_cut(spark):
    n, ranges = 100_000, 64
    df = spark.range(n).select(F.format_string("one-owner/with-a-long-prefix-%08d", "id").alias("name"), "id")
    order = [("name", True)]
    bounds = ranking.boundaries(df, order, ranges)
    assert len(bounds) <= ranges and max(map(len, bounds)) < 100
    largest = ranking.in_ranges(df, order, bounds).groupBy("__range").count().agg(F.max("count")).first()[0]
    assert largest < 4 * n / ranges
    result = ranking.numbered(df, order, "place", ranges=ranges)
    assert result.where("place <> %d - id" % n).count() == 0 and result.count() == n


def test_windows_over_rows_are_partitioned(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("name"))
    plan = ranking.numbered(df, [("name", False)], "place")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange SinglePartition" in line]
    assert len(exchanges) == 1  # the counts of the ranges, at most RANGES rows
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(__range", plan)
