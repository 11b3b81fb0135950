"""Embedding whitening by polarisation: the variances of all dimensions and of all sums of two dimensions give every covariance.

The covariance of two dimensions is half of what the variance of their sum exceeds their own variances by.  So one kind of aggregate is enough:
sums of exact squared centred values.  Values are whole numbers, centred without rounding as n * x - S, and their squares are summed in
whole numbers; only the finished covariances become doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from settlespark.llm.common import column_chunks
from settlespark.session import written

#: Rows squared at once; pairs of dimensions in one pass over them; bits of the low part of a centred value.
ROWS, PAIRS, LOW_BITS = 1024, 4096, 20
LEAST_SHARE = 1e-12


def _quantised(name: str, scale: int) -> Column:
    return F.transform(F.col(name).cast("array<double>"), lambda c: F.floor(c * scale))


def _usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, x (whole numbers) of the rows whose vector has only finite entries."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull()).where(~bad)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), _quantised("embedding", scale).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(-1, d)


def _sum_rows(d: int):
    """Exact sums of every dimension, in limbs of 32 bits so that no partial sum overflows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for batch in column_chunks(batches, ROWS):
            x = _matrix(batch.column(0), d)
            n += len(x)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(range(-1, d)), pa.int32()), pa.array([str(t) for t in [n, *total]])], ["at", "total"])

    return work


def _squares(y: np.ndarray) -> list[int]:
    """Exact column sums of squares of at most ``ROWS`` whole numbers."""
    if y.dtype == object or (len(y) and max(int(y.max()), -int(y.min())) >= 1 << 45):
        return [sum(v * v for v in column) for column in y.astype(object).T.tolist()]
    high, low = y >> LOW_BITS, y & ((1 << LOW_BITS) - 1)  # y = high * 2**20 + low; 1,024 products of at most 50 bits fit a long
    squared, mixed, rest = (high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0)
    return [(a << 2 * LOW_BITS) + (b << LOW_BITS + 1) + c for a, b, c in zip(squared.tolist(), mixed.tolist(), rest.tolist())]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as longs where they fit, otherwise as Python's whole numbers."""
    biggest = max(int(x.max()), -int(x.min())) if x.size else 0
    if n * biggest + max(map(abs, sums), default=0) < 1 << 61:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _pair_squares(n: int, sums: list[int]):
    """For every dimension (i, i) and every pair (i, j) the sum of the squares of the centred value, or of the pair's sum."""
    d = len(sums)
    first, second = np.triu_indices(d)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(first)
        some = False
        for batch in column_chunks(batches, ROWS):
            y = _centred(_matrix(batch.column(0), d), n, sums)
            some = some or len(y) > 0
            for at in range(0, len(first), PAIRS):
                i, j = first[at:at + PAIRS], second[at:at + PAIRS]
                found = _squares(np.where(i == j, y[:, i], y[:, i] + y[:, j]))
                total[at:at + PAIRS] = [a + b for a, b in zip(total[at:at + PAIRS], found)]
        if some:
            yield pa.RecordBatch.from_arrays(
                [pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array([str(t) for t in total])], ["i", "j", "total"])

    return work


def _exact_sum(name: str) -> Column:
    """The exact sum of whole numbers told as text, of any size: groups of 18 digits are summed each on their own."""
    size = F.lpad(F.regexp_replace(name, "^-", ""), 90, "0")
    sign = F.when(F.startswith(F.col(name), F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    return F.struct(*[F.sum((F.substring(size, 1 + 18 * k, 18).cast("bigint") * sign).cast("decimal(38,0)")).alias(f"d{k}") for k in range(5)])


def _whole(digits) -> int:
    found = 0
    for k in range(5):
        found = found * 10**18 + int(digits[f"d{k}"])
    return found


def _covariances(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance matrix over the fit list, every entry the double next to its exact value."""
    found = fit.select("x").mapInArrow(_pair_squares(n, sums), "i int, j int, total string")
    squares = {(r.i, r.j): _whole(r.s) for r in found.groupBy("i", "j").agg(_exact_sum("total").alias("s")).collect()}
    v = np.empty((d, d))
    for i in range(d):
        v[i, i] = squares[i, i] / n**3
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (squares[i, j] - squares[i, i] - squares[j, j]) / (2 * n**3)
    return v


def _components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that are not nought to double precision, falling, at most ``wanted``; unit eigenvectors as rows, the largest entry positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:wanted], vectors.T[::-1][:wanted].copy()
    keep = values > max(float(values[0]) if len(values) else 0.0, 0.0) * LEAST_SHARE
    values, vectors = values[keep], vectors[keep]
    for row in vectors:
        row *= np.sign(row[np.abs(row).argmax()])
    return values, vectors


def _project(n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
    d, k = len(sums), len(values)
    scaled = (vectors / np.sqrt(values)[:, None]).T

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_chunks(batches, ROWS):
            y = _centred(_matrix(batch.column(1), d), n, sums)
            w = (y.astype(np.float64) / n) @ scaled
            far = [str(sum(v * v for v in row)) for row in y.tolist()]
            m = len(y)
            ids = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(far).take(pa.array(ids)), pa.array(w.reshape(-1))],
                ["vec_id", "component", "deviation", "whitened"])

    return work


def _wide(n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
    scaled = (vectors / np.sqrt(values)[:, None]).T
    d, k = len(sums), len(values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_chunks(batches, ROWS):
            w = (_centred(_matrix(batch.column(0), d), n, sums).astype(np.float64) / n) @ scaled
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], [f"w{i}" for i in range(k)])

    return work


RESULT = "vec_id bigint, component int, n bigint, deviation string, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """One row per usable row of ``vectors`` (vec_id, embedding) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows without a vector or with a null or non-finite entry are dropped; entries become floor(scale * entry).  The estimates come from the fit list,
    each different vector once, so repeated rows count once but all are returned, also those without vec_id.  Vectors of another length
    than most of the usable rows (of equally frequent lengths the longest) have no place in the matrix and are dropped too.  Components are numbered by
    falling eigenvalue; one without any variance (to double precision) is left out, so an empty table, a single different vector or vectors of
    length 0 give no rows.  ``deviation`` is an exact whole number as text.  ``identity_error`` is measured on the whitened fit list.

    Only the d * (d + 1) / 2 sums of squares meet at the driver, whatever the number of rows; they and the components are all that is sent to the
    tasks.  Each task adds up its own rows first.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], RESULT)
    usable = _usable(vectors, scale)
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0].d:
        return nothing
    d = lengths[0].d
    usable = usable.where(F.size("x") == d)
    fit = written(usable.select("x").distinct(), "whitening-fit")
    told = fit.mapInArrow(_sum_rows(d), "at int, total string").groupBy("at").agg(_exact_sum("total").alias("s")).collect()
    sums = {r.at: _whole(r.s) for r in told}
    n = sums.pop(-1)
    sums = [sums[i] for i in range(d)]
    v = _covariances(fit, d, n, sums)
    values, axes = _components(v, components)
    k = len(values)
    if not k:
        return nothing
    work = _project(n, sums, values, axes)
    raw = "vec_id bigint, component int, deviation string, whitened double"

    # The whitened fit list, one row per vector, and its covariance.
    wide = fit.select("x").mapInArrow(_wide(n, sums, values, axes), ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = wide.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(got[f"c{i}_{j}"] - (1.0 if i == j else 0.0)) for i, j in pairs)

    share = [float(e / np.trace(v)) for e in values]
    explained = F.element_at(F.array(*[F.lit(s) for s in share]), F.col("component"))
    return usable.mapInArrow(work, raw).select(
        "vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
