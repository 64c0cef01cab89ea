"""Evaluate expensive columns exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that no later step evaluates again.

    The optimizer moves a filter on a plain projection below it and repeats the column's expression there, and again in
    every projection that uses it. Regex-heavy columns would run many times and outgrow code generation. A generator of
    one row stops that: filters stay above it, and everything above reads finished values.
    """
    kept = [c for c in df.columns if c not in columns]
    computed = df.select(*kept, *[c.alias("__once_" + name) for name, c in columns.items()])
    row = F.struct(*[F.col("__once_" + name).alias(name) for name in columns])
    return computed.select(*kept, F.inline(F.array(row)))
