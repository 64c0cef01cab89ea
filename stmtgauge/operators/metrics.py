"""Fixed-bucket histograms, quantiles from them, and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the two histograms.
BYTES_BOUNDS = (64, 256, 1024, 4096, 16384, 65536, 262144, 1048576)
LATENCY_BOUNDS_MS = (0.5, 1, 2, 5, 10, 20, 50, 100, 250)


def bucket_counts(col: str, bounds: Sequence[float]) -> list[Column]:
    """Cumulative count per bound, as plain aggregates (partial sums before any shuffle)."""
    return [F.count_if(F.col(col) <= float(b)).alias(f"__le{i}") for i, b in enumerate(bounds)]


def histogram(df: DataFrame, col: str, bounds: Sequence[float]) -> DataFrame:
    """(le, cum_count, sum, count): cumulative histogram; the infinite bucket is the row with the total."""
    totals = df.agg(*bucket_counts(col, bounds), F.sum(col).alias("__sum"), F.count(col).alias("__count"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"__le{i}").alias("cum_count")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("__count").alias("cum_count")))
    return totals.select(F.explode(F.array(*rows)).alias("b"), "__sum", "__count").select(
        "b.le", "b.cum_count", F.col("__sum").alias("sum"), F.col("__count").alias("count")
    )


def quantile(q: float, counts: Sequence[Column], total: Column, bounds: Sequence[float]) -> Column:
    """Quantile by linear interpolation inside the first bucket that reaches the rank.

    Above the last bound the last bound is returned; the first bucket starts at 0.
    """
    rank = total * F.lit(q)
    result = None
    for i, bound in enumerate(bounds):
        low = float(bounds[i - 1]) if i else 0.0
        below = counts[i - 1] if i else F.lit(0)
        inside = F.lit(low) + F.lit(float(bound) - low) * (rank - below) / F.nullif(counts[i] - below, F.lit(0))
        hit = counts[i] >= rank
        result = F.when(hit, inside) if result is None else result.when(hit, inside)
    return F.when(total > 0, result.otherwise(F.lit(float(bounds[-1]))))


def windowed_quantile(
    df: DataFrame,
    ts: str,
    col: str,
    q: float = 0.95,
    bounds: Sequence[float] = LATENCY_BOUNDS_MS,
    width: str = "5 minutes",
    slide: str | None = "1 minute",
) -> DataFrame:
    """(window_start, window_end, count, quantile) per sliding window.

    Batch rows are counted per ``slide`` first, so only one row per step, not every event, enters several windows. A
    stream counts straight into its windows: one stateful step under the watermark.
    """
    if slide and not df.isStreaming:
        steps = df.groupBy(F.window(ts, slide).alias("s")).agg(*bucket_counts(col, bounds), F.count(col).alias("__n"))
        sums = [F.sum(f"__le{i}").alias(f"__le{i}") for i in range(len(bounds))]
        grouped = steps.groupBy(F.window(F.col("s.start"), width, slide).alias("w"))
        counts = grouped.agg(*sums, F.sum("__n").alias("count"))
    else:
        window = F.window(ts, width, slide) if slide else F.window(ts, width)
        counts = df.groupBy(window.alias("w")).agg(*bucket_counts(col, bounds), F.count(col).alias("count"))
    value = quantile(q, [F.col(f"__le{i}") for i in range(len(bounds))], F.col("count"), bounds)
    return counts.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count", value.alias("quantile")
    )


def rate(df: DataFrame, ts: str, col: str, width: str = "1 minute", seconds: float = 60.0) -> DataFrame:
    """(window_start, per_second): sum of ``col`` per window divided by its seconds."""
    sums = df.groupBy(F.window(ts, width).alias("w")).agg(F.sum(col).alias("__sum"))
    return sums.select(F.col("w.start").alias("window_start"), (F.col("__sum") / F.lit(seconds)).alias("per_second"))
