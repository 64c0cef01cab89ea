"""Streaming jobs. Stateless steps and windowed aggregates are ordinary streaming queries, steps that depend on earlier
rows keep their state in Spark's store (see ``stateful``), and growing tables are logs of changes (see ``state``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stmtgauge.operators import metrics, packets, profiles
from stmtgauge.operators import decisions as D
from stmtgauge.operators.policy import decide, decide_as_of
from stmtgauge.plans import reports
from stmtgauge.sources.profiles import PROFILE_SCHEMA
from stmtgauge.sources.reports import write_report
from stmtgauge.sources.storage import remove
from stmtgauge.streaming.state import ChangeLog, kept

Sink = Callable[[DataFrame, int], None]

USAGE_SCHEMA = "table STRING, expression STRING, n BIGINT, star BIGINT"


def stream_decisions(events: DataFrame, rules: DataFrame, env: str | None = None, form: str = "auto") -> DataFrame:
    """Decisions on arriving events, append mode: literals or joins with the static rule side, no state."""
    return decide(events, rules, env, form)


def decisions_of_their_time(read_rules: Callable[[], DataFrame], sink: Sink, ts: str = "ts", env: str | None = None) -> Sink:
    """For ``foreachBatch`` on arriving events: decisions by the rules in force at the time of each event, late ones too.

    Rules are read anew for each batch, so a change takes effect without a restart; see ``policy.decide_as_of``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(decide_as_of(batch, read_rules(), ts, env), batch_id)

    return run


def stream_counters(log: DataFrame) -> DataFrame:
    """(key, n) running counters of an arriving decision log, update mode. Sums are partial before the shuffle."""
    return D.counter_increments(log).groupBy("key").agg(F.sum("by").alias("n"))


def stream_rate(events: DataFrame, ts: str, col: str, lateness: str = "1 minute") -> DataFrame:
    """Per-second rate of each minute; rows later than the watermark are dropped."""
    return metrics.rate(events.withWatermark(ts, lateness), ts, col)


def stream_quantile(events: DataFrame, ts: str, col: str, q: float = 0.95, lateness: str = "1 minute") -> DataFrame:
    """Quantile over five minutes, every minute; rows later than the watermark are dropped."""
    return metrics.windowed_quantile(events.withWatermark(ts, lateness), ts, col, q)


def reassembly(state_path: str, sink: Sink) -> Sink:
    """For ``foreachBatch`` on arriving packets: messages that end in the batch; other parts wait in a table of the batch.

    A batch reads what the one before it left and replaces what a failed attempt of its own wrote; what only earlier ones read
    goes. See ``stateful.stream_messages`` for the same with Spark's own state.
    """

    def folder(batch_id: int) -> str:
        return f"{state_path.rstrip('/')}/batch={batch_id}"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, parts = batch.sparkSession, packets.message_parts(batch)
        if batch_id:
            parts = spark.read.schema(packets.PART_SCHEMA).parquet(folder(batch_id - 1)).unionByName(parts)
        with kept(packets.number_parts(parts)) as numbered:
            sink(packets.join_parts(numbered), batch_id)
            waiting = numbered.where(~F.col("complete")).select(*parts.columns)
            waiting.write.mode("overwrite").parquet(folder(batch_id))
        if batch_id > 1:
            remove(spark, folder(batch_id - 2))

    return run


def profile_log(path: str, every: int = 8) -> ChangeLog:
    """Profiles by batch, see :func:`profile_batches`."""
    return ChangeLog(f"{path}/profiles", PROFILE_SCHEMA, profiles.merge_profiles, every)


def usage_log(path: str, every: int = 8) -> ChangeLog:
    """SELECT usage by batch, see :func:`profile_batches`."""
    return ChangeLog(f"{path}/usage", USAGE_SCHEMA, profiles.merge_usage, every)


def profile_batches(state_path: str, report_path: str, every: int = 8) -> Sink:
    """For ``foreachBatch`` on arriving query events: add the batch to the profiles and rewrite the report.

    Only the new events are read and only what they change is written; earlier ones are in the logs of changes, which are
    merged after ``every`` batches. Drift compares with the profiles before the batch.
    """
    known, used = profile_log(state_path, every), usage_log(state_path, every)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with kept(batch.select("ts", "sql_text")) as events:
            old = known.before(spark, batch_id)
            known.append(profiles.field_profiles(events), batch_id)
            used.append(profiles.select_usage(events), batch_id)
            day = events.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0] or ""
        new, usage = known.before(spark, batch_id + 1), used.before(spark, batch_id + 1)
        lines = reports.daily_report(spark, day, new, usage, old if batch_id else None)
        write_report(lines, f"{report_path}/batch={batch_id}")

    return run


def run_incremental(stream: DataFrame, job: Sink, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived since the last run, then stop. The caller chooses when to run."""
    query = stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
