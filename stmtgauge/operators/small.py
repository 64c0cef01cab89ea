"""Broadcast only what was measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 * 1024 * 1024


def byte_size(df: DataFrame) -> int:
    """Bytes of the rows as text, by one aggregation."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    return df.agg(size.cast("bigint")).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size allows it; else leave the join to shuffles and skew handling.

    For rule and type tables: the estimate the optimizer has for them is often missing, and without a hint the far
    larger event side would be shuffled.
    """
    return F.broadcast(df) if byte_size(df) <= limit else df
