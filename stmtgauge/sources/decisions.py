"""The decision log as a table of JSON lines, one folder per day."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.operators.correct import LOG_ORDER, LOG_TYPES
from stmtgauge.operators.small import broadcast_if_small
from stmtgauge.sources.events import parse_json_lines, utc, with_arrival_order
from stmtgauge.sources.storage import if_present


def append_decisions(df: DataFrame, path: str) -> None:
    """Stamp rows without ``ts`` and append them under their UTC day."""
    stamped = df.withColumn("ts", F.coalesce("ts", F.current_timestamp()))
    stamped.withColumn("ts_date", F.to_date(utc("ts"))).write.partitionBy("ts_date").mode("append").json(path)


def days_of(spark: SparkSession, path: str) -> list[str]:
    """Days that a log has folders of, the newest first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted((n.partition("=")[2] for n in names if re.fullmatch(r"ts_date=\d{4}-\d\d-\d\d", n)), reverse=True)


def read_last_decisions(spark: SparkSession, path: str, n: int, order: tuple[str, ...] = LOG_ORDER) -> DataFrame:
    """The last ``n`` logged decisions, by day and then ``order``.

    Days are walked from the newest backwards, and their rows counted, until there are ``n``; earlier folders are not
    looked at.
    """
    found, rows = None, 0
    for day in days_of(spark, path):
        of_day = read_decisions(spark, path, day)
        found = of_day if found is None else found.unionByName(of_day)
        rows += of_day.count()
        if rows >= n:
            break
    if found is None:
        fields = ", ".join(f"`{name}` {kind}" for name, kind in LOG_TYPES.items())
        return spark.createDataFrame([], f"{fields}, ts_date DATE")
    return found.orderBy(F.desc("ts_date"), *[F.desc(c) for c in order]).limit(n)


def read_decisions(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Logged decisions, malformed lines skipped; ``day`` lists and reads only the folder of that (UTC) day.

    Rows from single-file logs without ``seq`` get their arrival order.
    """
    folder = f"{path.rstrip('/')}/ts_date={day}"
    one_day = if_present(lambda: spark.read.option("basePath", path).text(folder)) if day else None
    lines = spark.read.text(path) if one_day is None else one_day
    wanted = F.col("ts_date") == F.lit(day).cast("date")
    if day and "ts_date" in lines.columns:
        lines = lines.where(wanted)
    rows = _parsed(lines)
    return rows.where(wanted) if day and "ts_date" not in lines.columns else rows


def _parsed(lines: DataFrame) -> DataFrame:
    fields = ", ".join(f"`{name}` {kind}" for name, kind in LOG_TYPES.items())
    ordered = with_arrival_order(lines).withColumnRenamed("seq", "__arrival")
    rows = parse_json_lines(ordered, fields).withColumn("seq", F.coalesce("seq", "__arrival")).drop("__arrival", "_metadata")
    return rows if "ts_date" in lines.columns else rows.withColumn("ts_date", F.to_date(utc("ts")))


def read_decisions_of(spark: SparkSession, path: str, days: DataFrame) -> DataFrame:
    """Logged decisions of the days in a small table (``ts_date`` DATE): its days prune the folders while the query runs."""
    wanted = days.select("ts_date").where(F.col("ts_date") > F.lit("0001-01-01").cast("date"))
    # Met right at the scan, where days can prune folders; the place of each line is kept for its arrival order.
    lines = spark.read.text(path).select("value", "ts_date", "_metadata")
    return _parsed(lines.join(broadcast_if_small(wanted), "ts_date", "left_semi"))
