"""What several operators share: written tables, document ranges, texts as bytes, checked broadcasts."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtgauge.sources.storage import fresh_folder, materialize

#: A side of a join is broadcast only when its measured size stays below this; beyond it both sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Ranges that quantiles are asked for at once.
COARSE = 1000
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Python workers find this package even where the session was started elsewhere."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """As ``materialize``, with the folder, for a table that is removed once it is used up."""
    path = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Rows with long arrays go to Python in batches of fewer rows; holds for what is written inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trimmed(f: Callable, *given: pd.DataFrame) -> pd.DataFrame:
    """What ``f`` makes of a group; the worker gives back what that has freed, which glibc keeps for the worker's life."""
    out = f(*given)
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    return out


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of ``df``, counted as ``rows`` rows of at most ``row_bytes``, if that is below ``limit``."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, for steps that name their number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """UTF-8 of a string column, one row after the other; null is empty."""
    values = batch.column(column)
    wide = pa.types.is_large_string(values.type)
    for v in values.cast(pa.large_binary() if wide else pa.binary()):
        yield v.as_py() or b""


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array], dropped: tuple[str, ...] = ()) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in dropped]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *added.values()], [*kept, *added])


def schema_with(df: DataFrame, **added: str) -> T.StructType:
    """Schema of ``df`` with further columns."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in added.items()]])


def spread(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows over as many tasks as there are cores where they lie in less than half as many; other scans are left alone."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def id_bounds(docs: DataFrame, parts: int, column: str = "doc_id") -> np.ndarray:
    """About ``parts - 1`` ascending ids that cut the rows into ranges of about equal counts.

    Reads the id column alone. Up to ``COARSE`` ranges come from approximate quantiles; more of them cut each of those
    evenly between its ends, since quantiles of every range would not fit into one aggregate. Null ids belong to no range.
    """
    coarse = min(parts, COARSE)
    shares = [i / coarse for i in range(1, coarse)]
    ends = (F.min(column), F.max(column), *([F.percentile_approx(column, shares, 100 * coarse)] if shares else []))
    low, high, *inner = docs.agg(*ends).first()
    if parts <= 1 or low is None:
        return np.empty(0, np.int64)
    if parts <= coarse:
        return np.unique(np.array(inner[0], np.int64))
    edges, each = [low, *sorted(set(inner[0])), high], -(-parts // coarse)
    return np.array(sorted({a + (b - a) * k // each for a, b in zip(edges, edges[1:]) for k in range(1, each + 1)}), np.int64)


def range_of(bounds: np.ndarray, column: str = "doc_id"):
    """Number of the range an id lies in: 0 for null, else 1 and up; equal ids share a range, larger ids a later one."""

    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        at = np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="right") + 1
        return pd.Series(np.where(null, 0, at).astype(np.int32))

    return find(F.col(column).cast("bigint"))


__all__ = [
    "BROADCAST_BYTES", "id_bounds", "materialize", "partitions", "range_of", "schema_with", "short_batches", "small", "spread", "table", "texts_of",
    "trimmed", "with_columns", "written",
]
