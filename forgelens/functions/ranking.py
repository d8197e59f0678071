"""Exact row numbers over tables of any size, without one task for all rows or for a large group."""

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgelens.sources.workspace import written

RANGES = 512
SAMPLED_PER_RANGE = 16
_RANGE, _OFFSET = "__range", "__offset"


def _sorts(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(name).desc() if descending else F.col(name).asc() for name, descending in order]


def _at_or_after(bound: Column, order: list[tuple[str, bool]]) -> Column:
    """Whether a row sorts at or after a boundary (nulls as Spark sorts them: lowest)."""
    result = F.lit(True)
    for name, descending in reversed(order):
        row, limit = F.col(name), bound.getField(name)
        low, high = (row, limit) if descending else (limit, row)
        after = F.coalesce(high > low, F.lit(False)) | (low.isNull() & high.isNotNull())
        result = after | (row.eqNullSafe(limit) & result)
    return result


def boundaries(df: DataFrame, order: list[tuple[str, bool]], ranges: int = RANGES) -> list[str]:
    """JSON of at most ``ranges`` - 1 sort keys that cut the rows into ranges of similar size.

    They are taken from a random sample of ``SAMPLED_PER_RANGE`` rows a range, the only rows that reach the driver.
    Any choice of boundaries gives the same numbers; the sample only evens out the ranges.
    """
    keys = df.select(*[name for name, _ in order])
    sample = keys.orderBy(F.rand(7)).limit(ranges * SAMPLED_PER_RANGE).orderBy(*_sorts(order))
    rows = [row.key for row in sample.select(F.to_json(F.struct(*keys.columns)).alias("key")).collect()]
    step = max(1, len(rows) // ranges)
    return list(dict.fromkeys(rows[step::step]))


def in_ranges(df: DataFrame, order: list[tuple[str, bool]], bounds: list[str]) -> DataFrame:
    """Rows with the number of boundaries that sort at or before them, found by binary search."""
    fields = df.select(*[name for name, _ in order]).schema.simpleString()
    held = F.from_json(F.lit(json.dumps([json.loads(bound) for bound in bounds])), f"array<{fields}>")
    steps = [1 << bit for bit in range(len(bounds).bit_length() - 1, -1, -1)]

    def advance(at: Column, step: Column) -> Column:
        inside = at + step <= len(bounds)
        return F.when(inside & _at_or_after(F.get(held, at + step - 1), order), at + step).otherwise(at)

    return df.withColumn(_RANGE, F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), advance))


def numbered(
    df: DataFrame, order: list[tuple[str, bool]], name: str, group: tuple[str, ...] = (), ranges: int = RANGES
) -> DataFrame:
    """Row number inside each group by ``order``, a list of (column, descending).

    The rows are written once.  Ranges of the full sort key (group first) are numbered independently, and the counts
    of a group's earlier ranges, at most ``ranges`` of them, are added.  A group that holds a large part of all rows, and
    names that share a long prefix, are thereby cut like any others.  Rows that tie in the whole key lie in one range, and
    which of them comes first is not defined.
    """
    rows = written(df, "numbered")
    full = [(column, False) for column in group] + list(order)
    placed = in_ranges(rows, full, boundaries(rows, full, ranges))
    key = [*group, _RANGE]
    before = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*key).agg(F.count("*").alias("n"))
    offsets = counts.withColumn(_OFFSET, F.coalesce(F.sum("n").over(before), F.lit(0))).select(
        *[F.col(column).alias(f"__{column}") for column in key], _OFFSET
    )
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*_sorts(order)))
    same = [placed[column].eqNullSafe(offsets[f"__{column}"]) for column in key]
    found = placed.withColumn(name, place.cast("bigint")).join(offsets, same, "inner")
    return found.withColumn(name, F.col(name) + F.col(_OFFSET)).select(*df.columns, name)
