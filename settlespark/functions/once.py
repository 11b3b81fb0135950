"""Evaluate a costly expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` behind a one-element explode.

    A filter on a derived column is pushed below its projection with the whole expression copied into it, so a parsed
    document or a keyed hash used in a few conditions would be computed a few times.  Filters on the output of
    an explode stay above it.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))
