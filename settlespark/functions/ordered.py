"""Row numbers, running sums and previous values over keys of any size.

A plain window puts one key into one task.  Here the rows are range-partitioned on (keys, order), so a
large key spans several slices of similar size; each slice is worked on alone and the slices of one key
are then stitched together by their totals.

The sliced rows are written once, because both the in-slice work and the totals must see the same
cut.  A key gains one extra (key, slice) pair for every slice boundary inside it, so the
stitching rows number fewer than the slices, however large the data: that is the bound behind the
broadcast below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from settlespark.session import written

SLICE = "_slice"


def sliced(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """The rows with the number of the slice they lie in, written; slices follow one another by (keys, order)."""
    cut = df.repartitionByRange(*keys, *order).withColumn(SLICE, F.spark_partition_id())
    return written(cut, label)


def _slice_window(keys: list[str]) -> Window:
    # One row per (key, slice): with no keys this is one row per slice.
    return Window.partitionBy(*keys).orderBy(SLICE)


def _stitch(cut: DataFrame, keys: list[str], carried: DataFrame, columns: list[str]) -> DataFrame:
    """Attach what the earlier slices of the same key carry over (only keys cut by a boundary)."""
    on = keys + [SLICE]
    side = carried.filter("_nth > 1").select(*[F.col(k).alias(f"_k_{k}") for k in on], *columns)
    same = None
    for k in on:
        term = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = term if same is None else same & term
    return cut.join(F.broadcast(side), same, "left").drop(*[f"_k_{k}" for k in on])


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """For each name in ``sums`` add the sum of that column from the key's first row to this one.

    ``order`` must be a total order within the key.
    """
    for name, col in sums.items():
        df = df.withColumn(f"_v_{name}", col)
    cut = sliced(df, keys, order, "running")
    totals = cut.groupBy(*keys, SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    w = _slice_window(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, SLICE, F.row_number().over(w).alias("_nth"),
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
    )
    local = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut
    for n in sums:
        out = out.withColumn(f"_l_{n}", F.sum(f"_v_{n}").over(local))
    out = _stitch(out, keys, carried, [f"_c_{n}" for n in sums])
    return out.select(
        *[c for c in df.columns if not c.startswith("_v_")],
        *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1, 2, 3 … within each key (or over everything when ``keys`` is empty)."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")})


def previous_values(df: DataFrame, keys: list[str], order: list[str], previous: dict[str, str]) -> DataFrame:
    """For each ``name: column`` add the column's value on the row before, plus ``is_first``."""
    cut = sliced(df, keys, order, "previous")
    carry = F.max_by(F.struct(*previous.values()), F.struct(*order)).alias("_last")
    w = _slice_window(keys)
    carried = (
        cut.groupBy(*keys, SLICE).agg(carry)
        .select(*keys, SLICE, F.row_number().over(w).alias("_nth"), F.lag("_last").over(w).alias("_before"))
    )
    local = Window.partitionBy(*keys, SLICE).orderBy(*order)
    out = cut.withColumn("_at", F.row_number().over(local))
    for name, column in previous.items():
        out = out.withColumn(f"_p_{name}", F.lag(column).over(local))
    out = _stitch(out, keys, carried, ["_before"])
    opens_slice = F.col("_at") == 1
    return out.select(
        *df.columns,
        *[
            F.when(opens_slice, F.col(f"_before.{column}")).otherwise(F.col(f"_p_{name}")).alias(name)
            for name, column in previous.items()
        ],
        (opens_slice & F.col("_before").isNull()).alias("is_first"),
    )
