"""Embedding whitening with a covariance recovered by polarisation.

Vectors become integers x = floor(256 * c).  The fit list holds each distinct x once: n vectors with sums S.  Centred
values n * x - S are integers, and for every dimension and every sum of two dimensions the squares of the centred values
are added up exactly.  With Q(i), Q(j) and Q(i, j) for those sums of squares, (Q(i, j) - Q(i) - Q(j)) / 2 is the
sum of products, so differences of variances give every cross-covariance; the matrix is put together on the driver and
given to eigh.

Squares are added in 64 bits in chunks that cannot overflow: values of more than 28 bits are cut in two limbs, values of
more than 56 bits are Python integers.  Each task sends one row a pair of dimensions, in limbs of 18 decimal digits, so what
is shuffled and what reaches the driver depends on the number of dimensions alone.

Defined results: rows whose vector is null or holds null or non-finite entries have no result; other rows each have
theirs, repeated ids and null ids included; a vector shorter than the longest counts as filled up with zeros; 256 * c beyond
64 bits becomes the nearest long; a component without variance (fewer distinct vectors than dimensions) has a null
``whitened`` and is not part of ``identity_error``; a deviation beyond 64 bits is null, ``deviation_exact`` has it
as text; an empty table gives an empty table.  Columns of the input other than the id and the vector are not read, so
their names cannot clash.
"""

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE = 256
COMPONENTS = 4
LIMB = 10**18
CHUNK_ROWS = 2048
NO_VARIANCE = 1e-12  # of the largest eigenvalue
SUMS = "i int, j int, low decimal(38,0), mid decimal(38,0), high decimal(38,0)"
SUM_FIELDS = pa.schema(
    [("i", pa.int32()), ("j", pa.int32()), *[(name, pa.decimal128(38, 0)) for name in ("low", "mid", "high")]]
)
ROWS = "vec_id long, component int, n long, deviation long, whitened double, deviation_exact string"
ROW_FIELDS = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
     ("whitened", pa.float64()), ("deviation_exact", pa.string())]
)


def whole(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x): sound vectors as integer arrays of one length."""
    sound = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = vectors.where(F.col(column).isNotNull()).where(sound)
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))


def filled_up(rows: DataFrame, length: int) -> DataFrame:
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < length, F.concat("x", zeros)).otherwise(F.col("x")))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64, copy=False).reshape(len(column), length)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as 64-bit integers where they and their pairwise sums fit, else as Python integers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    if most < 1 << 61:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(values: np.ndarray) -> list[int]:
    """Exact sum of squares of every column."""
    if values.dtype == object:
        return [int(total) for total in (values * values).sum(axis=0)]
    bits = int(np.abs(values).max(initial=0)).bit_length()
    if 2 * bits + len(values).bit_length() <= 63:
        return np.einsum("ri,ri->i", values, values).tolist()
    half = -(-bits // 2)
    if 2 * half + len(values).bit_length() > 63:
        return _squares(values.astype(object))
    high, low = values >> half, values & ((1 << half) - 1)
    parts = [np.einsum("ri,ri->i", a, b).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(hh << 2 * half) + (hl << half + 1) + ll for hh, hl, ll in zip(*parts)]


def square_sums(y: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums of squares: (i, i) of dimension i, (i, j) with i < j of the sum of two dimensions."""
    length, totals = y.shape[1], {}
    for at in range(0, len(y), CHUNK_ROWS):
        chunk = np.ascontiguousarray(y[at : at + CHUNK_ROWS])
        for i in range(length):
            columns = chunk[:, i:].copy()
            columns[:, 1:] += chunk[:, i : i + 1]
            for j, total in enumerate(_squares(columns), i):
                totals[i, j] = totals.get((i, j), 0) + total
    return totals


def covariance(totals: dict[tuple[int, int], int], n: int, length: int) -> np.ndarray:
    """The matrix of x by differences of variances, rounded once from exact integers."""
    out = np.empty((length, length))
    for (i, j), total in totals.items():
        products = total if i == j else (total - totals[i, i] - totals[j, j]) // 2
        out[i, j] = out[j, i] = products / n**3
    return out


class Model:
    """Mean and components of the fit list."""

    def __init__(self, n: int, sums: list[int], matrix: np.ndarray, components: int):
        self.n, self.sums = n, sums
        values, vectors = np.linalg.eigh(matrix)
        self.values, self.vectors = values[::-1], vectors[:, ::-1].T
        self.trace = float(np.trace(matrix))
        count = min(components, len(sums))
        self.values, self.vectors = self.values[:count], self.vectors[:count]
        self.usable = self.values > NO_VARIANCE * max(self.values[0], 0.0) if count else np.zeros(0, bool)
        self.explained = [float(e / self.trace) if self.trace > 0 else 0.0 for e in self.values]

    def score(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Exact deviations and whitened values, NaN for components without variance."""
        y = centred(x, self.n, self.sums)
        deviations = [int(d) for d in (y.astype(object) ** 2).sum(axis=1)] if y.dtype == object else _row_squares(y)
        projected = (y.astype(np.float64) / self.n) @ self.vectors.T
        scale = np.where(self.usable, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return deviations, projected / scale


def _row_squares(y: np.ndarray) -> list[int]:
    return _squares(np.ascontiguousarray(y.T))


def _partials(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    limbs = [[decimal.Decimal(part) for part in (v % LIMB, v // LIMB % LIMB, v // LIMB**2)] for v in totals.values()]
    columns = [list(column) for column in zip(*totals)] + [list(column) for column in zip(*limbs)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SUM_FIELDS)], schema=SUM_FIELDS)


def _added_up(distinct: DataFrame, length: int, totals_of) -> dict[tuple[int, int], int]:
    """Exact totals of what ``totals_of`` gives for a block of vectors; one row a key leaves a task."""

    def partial(batches):
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            for key, value in totals_of(matrix(batch.column(0), length)).items():
                totals[key] = totals.get(key, 0) + value
        if totals:
            yield _partials(totals)

    added = distinct.select("x").mapInArrow(partial, SUMS).groupBy("i", "j").agg(
        *[F.sum(name).alias(name) for name in ("low", "mid", "high")]
    )
    return {(row.i, row.j): int(row.low) + int(row.mid) * LIMB + int(row.high) * LIMB**2 for row in added.collect()}


def plain_sums(x: np.ndarray) -> dict[tuple[int, int], int]:
    """Number of vectors under (-1, -1) and the sum of dimension i under (i, i)."""
    totals = [(int(high) << 32) + int(low) for high, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
    return {(-1, -1): len(x), **{(i, i): total for i, total in enumerate(totals)}}


def fit(distinct: DataFrame, length: int, components: int = COMPONENTS) -> Model:
    """The model of a table of distinct vectors ``x`` of ``length`` entries."""
    plain = _added_up(distinct, length, plain_sums)
    n, sums = plain.get((-1, -1), 0), [plain.get((i, i), 0) for i in range(length)]
    totals = _added_up(distinct, length, lambda x: square_sums(centred(x, n, sums)))
    return Model(n, sums, covariance(totals, n, length), components)


def scored(rows: DataFrame, model: Model, length: int) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, deviation_exact) of integer vectors ``x``."""
    count = len(model.values)

    def run(batches):
        for batch in batches:
            deviations, white = model.score(matrix(batch.column(1), length))
            fits = [d if d < 1 << 63 else None for d in deviations]
            times = len(deviations) * count
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(deviations)), count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(deviations))),
                    pa.array(np.full(times, model.n, np.int64)),
                    pa.array([d for d in fits for _ in range(count)], pa.int64()),
                    pa.array(white.ravel(), mask=np.isnan(white.ravel())),
                    pa.array([str(d) for d in deviations for _ in range(count)], pa.string()),
                ],
                schema=ROW_FIELDS,
            )

    return rows.select("vec_id", "x").mapInArrow(run, ROWS)


def identity_error(fitted: DataFrame, model: Model, length: int) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity), measured in a pass of its own."""
    usable = [i for i, kept in enumerate(model.usable) if kept]
    if not usable:
        return 0.0
    names = [f"w{i:06d}" for i in usable]

    def run(batches):
        for batch in batches:
            white = model.score(matrix(batch.column(0), length))[1][:, usable]
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in white.T], names)

    white = fitted.select("x").mapInArrow(run, ", ".join(f"{name} double" for name in names))
    pairs = [(a, b) for a in names for b in names if a <= b]
    entries = white.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    return max(abs(value - (a == b)) for (a, b), value in zip(pairs, entries))


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per sound vector and component: (vec_id, component, n, deviation, whitened, deviation_exact, explained,
    identity_error)."""
    rows = written(whole(vectors, id_column, column), "whole")
    shortest, longest = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    length = longest or 0
    if shortest != longest:
        rows = filled_up(rows, length)
    fitted = written(rows.select("x").distinct(), "fit-list")
    model = fit(fitted, length, components)
    explained = F.element_at(F.array(*map(F.lit, model.explained)), F.col("component")) if model.explained else F.lit(None)
    return scored(rows, model, length).withColumns(
        {
            "explained": explained.cast("double"),
            "identity_error": F.lit(identity_error(fitted, model, length)).cast("double"),
        }
    )


def query(spark, sf_dir) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
