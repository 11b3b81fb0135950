"""First-per-key and duplicate marking that never gathers one key's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``.

    ``min_by`` is combined before the shuffle, so a key holding a third of the rows costs one
    partial row per input task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, "_first.*").select(*df.columns)


def mark_first(df: DataFrame, keys: list[str], order: list[str], row_id: str, flag: str,
               among: Column | None = None) -> DataFrame:
    """Add ``flag``: true on the first row of each key (among the rows meeting ``among``).

    The winner per key is found by a combinable aggregate; the way back joins on the unique row id,
    so a hot key is spread over all tasks.
    """
    pool = df if among is None else df.filter(among)
    winners = (
        pool.groupBy(*keys)
        .agg(F.min_by(F.col(row_id), F.struct(*order)).alias(row_id))
        .select(row_id, F.lit(True).alias(flag))
    )
    return df.join(winners, row_id, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def repeated_keys(df: DataFrame, keys: list[str], count_as: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_as)).filter(F.col(count_as) > 1)
