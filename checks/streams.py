"""Streaming queries over the events table: the same results as their batch forms, produced in several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as V
from stmtgauge.operators import correct
from stmtgauge.sources.storage import fresh_folder, if_present


#: Micro-batches into which the events are dealt, and events in one of their files.
BATCHES, FILE_ROWS = 5, 20_000


def turns(events: DataFrame) -> tuple[list[tuple], int]:
    """Bounds of ``event_id`` (over, up to) that deal the events into batches, and the number of files of each."""
    shares = [i / BATCHES for i in range(1, BATCHES)]
    ends, n = events.agg(F.percentile_approx("event_id", shares), F.count("*")).first()
    ends = ends or []
    return list(zip([None, *ends], [*ends, None])), max(1, n // (BATCHES * FILE_ROWS))


def between(events: DataFrame, low, high) -> DataFrame:
    part = events if low is None else events.where(F.col("event_id") > low)
    return part if high is None else part.where(F.col("event_id") <= high)


def append_files(part: DataFrame, folder: str, kind: str, files: int) -> None:
    """Append exactly so many files, which many tasks write: a stream that takes as many at once gets all of ``part``."""
    spark = part.sparkSession
    there = lambda: len(spark.read.format(kind).schema(part.schema).load(folder).inputFiles())
    before = there() if if_present(lambda: spark.read.format(kind).schema(part.schema).load(folder)) is not None else 0
    part.repartition(files).write.mode("append").format(kind).save(folder)
    for _ in range(before + files - there()):  # fewer rows than files
        part.limit(0).coalesce(1).write.mode("append").format(kind).save(folder)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as they would arrive: files in order of event id, as many to a batch as its events need."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = fresh_folder(spark, "events")
    spans, files = turns(events)
    for low, high in spans:  # one after the other: files are read in order of their age
        append_files(between(events, low, high), folder, "parquet", files)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.finished(spark.sql(V.QUERY_LOG, events=event_stream(spark, sf_dir)))


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is and read what it wrote."""
    spark = stream.sparkSession
    out, checkpoint = fresh_folder(spark, "stream"), fresh_folder(spark, "checkpoint")
    if mode == "append":
        query = (
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    else:
        # Aggregates in update mode: the last value of a key is the one of the highest batch.
        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        query = (
            stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(out)


def latest(table: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, "r.*")


def decision_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, rules = log_stream(spark, sf_dir), V.rules(spark)
    return correct.statement_decisions(log, rules).unionByName(correct.cell_corrections(log, rules, mode="enforce"))
