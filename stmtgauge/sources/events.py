"""Query events: JSON lines, event XML, and the daily JSON-lines sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stmtgauge.operators.small import broadcast_if_small

EVENT_FIELDS = """timestamp STRING, event STRING, database STRING, user STRING, client_app STRING, client_host STRING,
    sql_text STRING, duration_ms BIGINT, row_count BIGINT, cpu_time_ms BIGINT, error BIGINT"""
POLICY_EVENT_FIELDS = "database STRING, user STRING, sql_text STRING, table STRING, column STRING, value STRING"
_CORRUPT = "_corrupt_record"

_XML_ITEM = "ARRAY<STRUCT<_name STRING, _value STRING, value STRING>>"
XML_SCHEMA = f"_name STRING, _timestamp STRING, action {_XML_ITEM}, data {_XML_ITEM}"

_FILE_BITS = 41
_LINE_MASK = (1 << 33) - 1


def _plain_path(path: Column) -> Column:
    """One spelling for ``file:///x`` and ``file:/x``."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def with_arrival_order(df: DataFrame) -> DataFrame:
    """Add ``seq`` to a file scan: files by path, then lines, as one BIGINT and without sorting anything.

    ``seq`` = file number * 2^41 + byte offset of the split + line number in the scan task. A line has at least one
    byte and a full split is alone in its task, so the sum never reaches the next split of the file. More files or
    longer files than the bits can number are an error. The list of files is what the scan holds on the driver anyway.
    """
    files = [(path, n) for n, path in enumerate(sorted(df.inputFiles()))]
    numbers = df.sparkSession.createDataFrame(files, "path STRING, __file BIGINT")
    numbers = broadcast_if_small(numbers.select(_plain_path(F.col("path")).alias("__path"), "__file"))
    placed = df.select(
        "*",
        _plain_path(F.col("_metadata.file_path")).alias("__path"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(_LINE_MASK)).alias("__place"),
    )
    fits = (F.col("__file") < (1 << (63 - _FILE_BITS))) & (F.col("__place") < (1 << _FILE_BITS))
    numbered = F.shiftleft(F.col("__file"), _FILE_BITS) + F.col("__place")
    seq = F.when(fits, numbered).otherwise(F.raise_error("too many or too long files to number their lines"))
    return placed.join(numbers, "__path").withColumn("seq", seq).drop("__path", "__file", "__place")


def parse_json_lines(lines: DataFrame, fields: str) -> DataFrame:
    """Replace the text column ``value`` by the fields of its JSON object; lines that are no JSON object are skipped.

    Every field is read as text and cast afterwards, so an object stays whatever JSON type a field has: a number in a text
    field becomes its text, a fraction in a whole-number field loses its fraction, anything else that does not fit is NULL.
    """
    kinds = T.StructType.fromDDL(fields)
    as_text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in kinds], T.StructField(_CORRUPT, T.StringType())])
    parsed = lines.where(F.col("value").rlike(r"^\s*\{")).select(
        *[c for c in lines.columns if c != "value"],
        F.from_json("value", as_text, {"columnNameOfCorruptRecord": _CORRUPT}).alias("__j"),
    )
    sound = parsed.where(F.col("__j").isNotNull() & F.col(f"__j.{_CORRUPT}").isNull())
    return sound.select(
        *[c for c in parsed.columns if c != "__j"], *[_typed(F.col(f"__j.`{f.name}`"), f.dataType).alias(f.name) for f in kinds]
    )


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.IntegralType):
        return F.coalesce(text.try_cast(kind), text.try_cast("decimal(38,10)").try_cast(kind))
    return text.try_cast(kind)


def utc(ts: str) -> Column:
    """Wall clock of the instant in UTC, whatever the zone of the session."""
    return F.to_utc_timestamp(ts, F.current_timezone())


def read_json_lines(spark: SparkSession, path: str, fields: str, streaming: bool = False) -> DataFrame:
    """JSON lines with a fixed schema; lines that are no JSON object are skipped.

    A batch gets ``seq``, its arrival order. A stream has none: there ``seq`` is a field the producer writes.
    """
    if streaming:
        return parse_json_lines(spark.readStream.text(path), f"{fields}, seq BIGINT")
    return parse_json_lines(with_arrival_order(spark.read.text(path)), fields)


def read_query_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Query events with ``ts`` next to the original ``timestamp`` text."""
    df = read_json_lines(spark, path, EVENT_FIELDS, streaming)
    return df.withColumn("ts", F.col("timestamp").try_cast("timestamp"))


def read_policy_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Events to evaluate rules on: text, table, column and value, all optional."""
    return read_json_lines(spark, path, POLICY_EVENT_FIELDS, streaming)


def _last(items: str, *names: str) -> Column:
    """Value of the last action or data item with one of the names; attribute and child values are both accepted."""
    found = F.filter(items, lambda d: d["_name"].isin(*names))
    item = F.try_element_at(found, F.lit(-1))
    return F.coalesce(item["_value"], item["value"])


def read_event_xml(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Query events from event-session XML, one row per ``<event>``; durations keep the unit of the session. A stream has no
    ``seq`` and takes at most ``max_files`` files into a batch."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.option("maxFilesPerTrigger", max_files) if streaming and max_files else reader
    xml = reader.format("xml").option("rowTag", "event").schema(XML_SCHEMA).load(path)
    number = lambda name: _last("data", name).try_cast("bigint")
    placed = xml if streaming else with_arrival_order(xml)
    return placed.select(
        *([] if streaming else ["seq"]),
        F.col("_timestamp").alias("timestamp"),
        F.col("_timestamp").try_cast("timestamp").alias("ts"),
        F.col("_name").alias("event"),
        _last("action", "database_name").alias("database"),
        _last("action", "username").alias("user"),
        _last("action", "client_app_name").alias("client_app"),
        _last("action", "client_hostname").alias("client_host"),
        _last("data", "statement", "batch_text").alias("sql_text"),
        number("duration").alias("duration_ms"),
        number("row_count").alias("row_count"),
        number("cpu_time").alias("cpu_time_ms"),
        number("error").alias("error"),
    )


def by_utc_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format(utc("ts"), "yyyyMMdd"))


def write_query_events(df: DataFrame, path: str) -> None:
    """Append events as JSON lines in one folder per UTC day (``day=YYYYMMDD``)."""
    by_utc_day(df).write.partitionBy("day").mode("append").json(path)


def sink_query_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving events as :func:`write_query_events` does: all that is there by now, each once.

    The sink keeps a log of the files it has committed, and Spark reads the folder by that log. A query that was killed
    goes on from its checkpoint; what it had written without committing is not read.
    """
    writer = by_utc_day(stream).writeStream.format("json").partitionBy("day").option("path", path)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def without_repeats(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Events of a source that is read again and again, each once.

    Two events are the same when all fields but ``seq`` are. A stream remembers a digest of those no older than
    ``lateness`` before the newest ``ts``, so its state is bounded; what is older counts as seen. Events without a time
    pass as they are. In a batch everything is compared.
    """
    fields = [c for c in events.columns if c != "seq"]
    told = F.md5(F.to_json(F.struct(*fields)).cast("binary")).alias("__told")
    known = events.select("*", told)
    if not events.isStreaming:
        kept = known.where("ts IS NOT NULL").dropDuplicates(["__told"])
    else:
        kept = known.where("ts IS NOT NULL").withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["__told"])
    return kept.unionByName(known.where("ts IS NULL")).drop("__told")
