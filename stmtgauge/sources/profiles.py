"""Snapshots of field profiles and SELECT usage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.sources.storage import if_present, remove

#: Buckets of a snapshot; snapshots that are to be joined have as many.
BUCKETS = 8

PROFILE_SCHEMA = "field STRING, count BIGINT, nulls BIGINT, suggestions MAP<STRING, BIGINT>"
SELECT_SCHEMA = "table STRING, star BIGINT, columns MAP<STRING, BIGINT>"
_FIELD = "STRUCT<count: BIGINT, nulls: BIGINT, suggestions: MAP<STRING, BIGINT>>"
_TABLE = "STRUCT<star: BIGINT, columns: MAP<STRING, BIGINT>>"


def write_snapshot(df: DataFrame, path: str, snapshot_date: str) -> None:
    """Write one snapshot; writing the same date again replaces it."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/snapshot_date={snapshot_date}")


def read_snapshot(spark: SparkSession, path: str, snapshot_date: str, schema: str = PROFILE_SCHEMA) -> DataFrame:
    """A snapshot, empty when there is none of that date."""
    folder = f"{path.rstrip('/')}/snapshot_date={snapshot_date}"
    found = if_present(lambda: spark.read.schema(schema).parquet(folder))
    return spark.createDataFrame([], schema) if found is None else found


def write_bucketed_snapshot(df: DataFrame, path: str, snapshot_date: str, key: str = "field", buckets: int = BUCKETS) -> None:
    """Write one snapshot in buckets of ``key``, one sorted file each, so that two snapshots join without an exchange.

    A snapshot of the same date is removed first.
    """
    spark, folder = df.sparkSession, f"{path.rstrip('/')}/snapshot_date={snapshot_date}"
    remove(spark, folder)
    name = f"snapshot_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    dealt.option("path", folder).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay


def read_bucketed_snapshot(
    spark: SparkSession, path: str, snapshot_date: str, schema: str = PROFILE_SCHEMA, key: str = "field", buckets: int = BUCKETS
) -> DataFrame:
    """A snapshot written by :func:`write_bucketed_snapshot` with as many buckets; empty when there is none of that date.

    The session learns of the buckets by a table over the folder, which holds no data of its own.
    """
    folder = f"{path.rstrip('/')}/snapshot_date={snapshot_date}"
    if if_present(lambda: spark.read.schema(schema).parquet(folder)) is None:
        return spark.createDataFrame([], schema)
    name = f"snapshot_{uuid.uuid4().hex}"
    place = folder.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)


def read_profiles_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Profiles and SELECT usage of a JSON snapshot: ``{"profiles": .., "selects": ..}`` or the profiles alone."""
    text = if_present(lambda: spark.read.text(path, wholetext=True))
    if text is None:
        return spark.createDataFrame([], PROFILE_SCHEMA), spark.createDataFrame([], SELECT_SCHEMA)
    nested = F.array_contains(F.json_object_keys("value"), "profiles")
    profiles = F.when(nested, F.get_json_object("value", "$.profiles")).otherwise(F.col("value"))
    selects = F.when(nested, F.get_json_object("value", "$.selects"))
    fields = text.select(F.explode(F.from_json(profiles, f"MAP<STRING, {_FIELD}>")).alias("field", "p"))
    tables = text.select(F.explode(F.from_json(selects, f"MAP<STRING, {_TABLE}>")).alias("table", "t"))
    zero = F.lit(0).cast("bigint")
    return (
        fields.select(
            "field",
            F.coalesce("p.count", zero).alias("count"),
            F.coalesce("p.nulls", zero).alias("nulls"),
            F.coalesce("p.suggestions", F.create_map().cast("map<string,bigint>")).alias("suggestions"),
        ),
        tables.select("table", F.coalesce("t.star", zero).alias("star"), F.col("t.columns").alias("columns")),
    )
