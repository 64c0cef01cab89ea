"""Queries that write the readers' input from the driver tables and read it back: sources and sinks of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import streams
from checks import views as V
from checks.registry import big, register
from stmtgauge.operators import profiles
from stmtgauge.operators.running import running_total
from stmtgauge.sources import decisions as decision_log
from stmtgauge.sources import events, rules
from stmtgauge.sources import profiles as snapshots
from stmtgauge.sources import reports as report_files
from stmtgauge.sources.storage import fresh_folder, materialize

# Objects with fields of several JSON types, and lines that are no object. Spark and the checking database both read this.
_LINES = """
    SELECT event_id, CASE event_id % 9
        WHEN 0 THEN concat('{{"event": "', event_type, '", "duration_ms": ', CAST(event_id AS STRING), ', "user": "u', CAST(user_id AS STRING), '"}}')
        WHEN 1 THEN concat('{{"event": "', event_type, '", "duration_ms": ', CAST(event_id AS STRING), '.5}}')
        WHEN 2 THEN concat('{{"event": "', event_type, '", "duration_ms": "fast", "row_count": "', CAST(user_id AS STRING), '"}}')
        WHEN 3 THEN concat('  {{"event": ', CAST(user_id AS STRING), ', "duration_ms": true, "other": [1, 2]}}')
        WHEN 4 THEN concat('{{"event": {{"name": "', event_type, '"}}, "row_count": null}}')
        WHEN 5 THEN concat('{{"event": "', event_type)
        WHEN 6 THEN '[1, 2]'
        WHEN 7 THEN ''
        ELSE concat('"', event_type, '"') END AS value
    FROM {events}
"""


@register(
    "source_query_events",
    """SELECT CASE m WHEN 3 THEN user_id::VARCHAR WHEN 4 THEN concat('{"name":"', event_type, '"}') ELSE event_type END AS event,
        CASE WHEN m < 2 THEN event_id END AS duration_ms, CASE m WHEN 2 THEN user_id END AS row_count,
        CASE m WHEN 0 THEN concat('u', user_id) END AS user_name FROM (SELECT *, event_id % 9 AS m FROM events) WHERE m < 5""",
)
def _(spark, sf_dir):
    folder = fresh_folder(spark, "lines")
    V.sql_view(spark, sf_dir, _LINES, "events").select("value").write.text(folder)
    read = events.read_query_events(spark, folder)
    return read.select(F.regexp_replace("event", r"\s", "").alias("event"), "duration_ms", "row_count", F.col("user").alias("user_name"))


@register(
    "source_events_by_day",
    """SELECT strftime(ts, '%Y%m%d')::BIGINT AS day, event_type AS event, count(*) AS n, count(DISTINCT event_id) AS places,
        sum(event_id)::BIGINT AS total FROM events GROUP BY ALL""",
)
def _(spark, sf_dir):
    """Written under a session zone other than UTC and read back: days are those of UTC."""
    folder = fresh_folder(spark, "events")
    zone = spark.conf.get("spark.sql.session.timeZone")
    log = V.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("event"), F.col("event_id").alias("row_count"))
    log = materialize(log.withColumn("ts", F.col("ts").cast("timestamp")), "events")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Stockholm")
    try:
        events.write_query_events(log, folder)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    read = events.with_arrival_order(spark.read.text(folder))
    parsed = events.parse_json_lines(read, "event STRING, row_count BIGINT")
    return parsed.groupBy(big("day"), "event").agg(
        F.count("*").alias("n"), F.countDistinct("seq").alias("places"), F.sum("row_count").alias("total")
    )


_XML = """
    SELECT concat('<event name="', event_type, '" timestamp="2024-01-02T03:04:05.000Z"><action name="username"><value>u',
        CAST(user_id AS STRING), '</value></action><data name="duration"><value>', CAST(event_id AS STRING),
        '</value></data><data name="', CASE WHEN event_id % 2 = 0 THEN 'statement' ELSE 'batch_text' END,
        '"><value>SELECT ', CAST(event_id AS STRING), ' FROM dbo.T</value></data></event>') AS value FROM {events}
"""


#: Rules or types in one file, and events in one of a session.
_FILE_ROWS, _XML_ROWS = 1000, 5000


def _xml_roots(events_: DataFrame) -> DataFrame:
    """Files of the session: each has one root element around some of the events."""
    files = -(-max(1, events_.count()) // _XML_ROWS)
    # As many tasks as files: what a file holds is a single value of many bytes, of which a task writes one.
    parts = events_.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(files))).repartition(files, "part").groupBy("part")
    roots = parts.agg(F.concat(F.lit("<events>"), F.array_join(F.collect_list("value"), ""), F.lit("</events>")).alias("value"))
    return roots.select("value")


@register(
    "source_event_xml",
    """SELECT event_type AS event, concat('u', user_id) AS user_name, event_id AS duration_ms,
        concat('SELECT ', event_id, ' FROM dbo.T') AS sql_text, '2024-01-02 03:04:05' AS ts FROM events""",
)
def _(spark, sf_dir):
    folder = fresh_folder(spark, "xml")
    _xml_roots(V.sql_view(spark, sf_dir, _XML, "events")).write.option("maxRecordsPerFile", 1).text(folder)
    read = events.read_event_xml(spark, folder)
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    return read.select("event", F.col("user").alias("user_name"), "duration_ms", "sql_text", ts)


def _read_again(arriving: DataFrame) -> tuple[list[DataFrame], int]:
    """What a reader of a ring buffer gets turn by turn: some new events, and those of the turn before once more. And the
    number of files for each turn."""
    spans, files = streams.turns(arriving)
    lows = [None, *[low for low, _ in spans]]
    return [streams.between(arriving, low, high) for low, (_, high) in zip(lows, spans)], 2 * files


_STAMPED = """SELECT event_id, concat('{{"timestamp": "', date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), '", "event": "', event_type,
    '", "user": "u', CAST(user_id AS STRING), '", "row_count": ', CAST(event_id AS STRING), '}}') AS value FROM {events}"""


@register(
    "source_events_read_again",
    """SELECT strftime(ts, '%Y%m%d')::BIGINT AS day, event_type AS event, concat('u', user_id) AS user_name, event_id AS row_count
        FROM events""",
)
def _(spark, sf_dir):
    """A source that is read again in every turn, through the duplicate state into the sink by day: each event once."""
    raw, out, checkpoint = (fresh_folder(spark, n) for n in ("raw", "days", "checkpoint"))
    turns, files = _read_again(V.sql_view(spark, sf_dir, _STAMPED, "events"))
    for turn in turns:
        streams.append_files(turn.select("value"), raw, "text", files)
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(raw)
    arriving = events.parse_json_lines(lines, events.EVENT_FIELDS).withColumn("ts", F.col("timestamp").try_cast("timestamp"))
    events.sink_query_events(events.without_repeats(arriving, "1 minute"), out, checkpoint)
    read = spark.read.schema("event STRING, user STRING, row_count BIGINT, day BIGINT").json(out)
    return read.select("day", "event", F.col("user").alias("user_name"), "row_count")


_XML_AGAIN = """
    SELECT event_id, concat('<event name="', event_type, '" timestamp="', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        '"><data name="duration"><value>', CAST(event_id AS STRING), '</value></data></event>') AS value FROM {events}
"""


@register("source_xml_read_again", "SELECT event_type AS event, event_id AS duration_ms FROM events")
def _(spark, sf_dir):
    """Session files that repeat the events of the turn before."""
    raw, out, checkpoint = (fresh_folder(spark, n) for n in ("xml", "days", "checkpoint"))
    for turn in _read_again(V.sql_view(spark, sf_dir, _XML_AGAIN, "events"))[0]:
        _xml_roots(turn).write.mode("append").option("maxRecordsPerFile", 1).text(raw)
    # The number of batches follows the turns and not the events: each takes about as many files as a turn has.
    most = -(-len(spark.read.text(raw).inputFiles()) // streams.BATCHES)
    arriving = events.read_event_xml(spark, raw, streaming=True, max_files=most)
    # The files of a turn come in any order, so a turn must fit into the time that is remembered.
    events.sink_query_events(events.without_repeats(arriving, "60 days"), out, checkpoint)
    return spark.read.schema("event STRING, duration_ms BIGINT, day BIGINT").json(out).select("event", "duration_ms")


@register(
    "source_rules",
    """SELECT n - 1 AS place, id, target, selector, action, min_hits FROM (SELECT *, row_number() OVER (ORDER BY ord) AS n
        FROM rule_table) WHERE lower(target) IN ('table', 'column', 'pattern')
        AND lower(action) IN ('allow', 'block', 'autocorrect') AND selector IS NOT NULL AND id IS NOT NULL""",
)
def _(spark, sf_dir):
    folder = fresh_folder(spark, "rules")
    given = V.sql_view(spark, sf_dir, V.RULE_TABLE, "part").withColumnRenamed("min_hits", "min_hits_to_enforce")
    # A rule file is one JSON array; files in order of their names hold the rules in order.
    entries = F.array_sort(F.collect_list(F.struct(*given.columns)))
    files = given.groupBy(F.floor(F.col("ord") / _FILE_ROWS).alias("part")).agg(F.to_json(entries).alias("value"))
    files.repartitionByRange("part").sortWithinPartitions("part").select("value").write.option("maxRecordsPerFile", 1).text(folder)
    read = rules.read_rules(spark, folder)
    return read.select(big("ord", "place"), "id", "target", "selector", "action", big("min_hits_to_enforce", "min_hits"))


@register(
    "source_param_types",
    """SELECT concat('dbo.p', p_partkey) AS proc, lower(replace(p_brand, '#', '')) AS param, p_type AS type FROM part""",
)
def _(spark, sf_dir):
    folder = fresh_folder(spark, "types")
    name = F.concat(F.lit("@"), F.replace("p_brand", F.lit("#"), F.lit("")))
    entry = F.struct(F.concat(F.lit("DBO.P"), "p_partkey").alias("k"), F.create_map(name, F.col("p_type")).alias("v"))
    part = V.table(spark, sf_dir, "part")
    files = part.groupBy(F.floor(F.col("p_partkey") / _FILE_ROWS)).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return rules.read_param_types(spark, folder)


@register(
    "source_decisions_of_day",
    """SELECT seq, step::BIGINT AS step, row_no::BIGINT AS row_no, pos::BIGINT AS pos, action, rule_id, confidence FROM decisions
        WHERE ts::DATE = DATE '2024-01-10'""",
)
def _(spark, sf_dir):
    folder = fresh_folder(spark, "decisions")
    decision_log.append_decisions(V.decisions_log(spark, sf_dir).drop("ts_date"), folder)
    read = decision_log.read_decisions(spark, folder, "2024-01-10")
    return read.select("seq", big("step"), big("row", "row_no"), big("pos"), "action", "rule_id", "confidence")


@register(
    "source_snapshots",
    """SELECT coalesce(p.field, c.field) AS field, coalesce(p.n_nulls, 0) AS nulls_before, coalesce(c.n_nulls, 0) AS nulls_after
        FROM profiles_prev AS p FULL OUTER JOIN profiles_curr AS c ON c.field = p.field""",
)
def _(spark, sf_dir):
    folder = fresh_folder(spark, "profiles")
    log = V.query_log(spark, sf_dir)
    early = F.col("client_app").isin("click", "view")
    for date, part in (("20240101", log.where(early)), ("20240102", log.where(~early))):
        snapshots.write_snapshot(profiles.field_profiles(part), folder, date)
    before, after = (snapshots.read_snapshot(spark, folder, d) for d in ("20240101", "20240102"))
    met = before.select("field", F.col("nulls").alias("b")).join(after.select("field", F.col("nulls").alias("a")), "field", "full")
    return met.select("field", F.coalesce("b", F.lit(0)).alias("nulls_before"), F.coalesce("a", F.lit(0)).alias("nulls_after"))


@register(
    "drift_of_bucketed_snapshots",
    """SELECT coalesce(p.field, c.field) AS field, coalesce(p.n_nulls, 0) AS nulls_before, coalesce(c.n_nulls, 0) AS nulls_after
        FROM profiles_prev AS p FULL OUTER JOIN profiles_curr AS c ON c.field = p.field""",
)
def _(spark, sf_dir):
    """Snapshots in buckets by field meet without an exchange."""
    folder = fresh_folder(spark, "profiles")
    log = V.query_log(spark, sf_dir)
    early = F.col("client_app").isin("click", "view")
    for date, part in (("20240101", log.where(early)), ("20240102", log.where(~early))):
        snapshots.write_bucketed_snapshot(profiles.field_profiles(part), folder, date)
    before, after = (snapshots.read_bucketed_snapshot(spark, folder, d) for d in ("20240101", "20240102"))
    met = before.select("field", F.col("nulls").alias("b")).join(after.select("field", F.col("nulls").alias("a")), "field", "full")
    return met.select("field", F.coalesce("b", F.lit(0)).alias("nulls_before"), F.coalesce("a", F.lit(0)).alias("nulls_after"))


@register("source_report_lines", "SELECT n AS place, concat('- ', field) AS line FROM (SELECT field, row_number() OVER (ORDER BY field) AS n FROM profiles)")
def _(spark, sf_dir):
    """Lines come back in the order in which the report has them."""
    folder = fresh_folder(spark, "report")
    fields = profiles.field_profiles(V.query_log(spark, sf_dir)).select(
        F.lit(1).alias("section"), F.lit(0).alias("place"), F.col("field").alias("name"), F.lit(0).alias("sub"),
        F.concat(F.lit("- "), "field").alias("line"),
    )
    report_files.write_report(fields, folder)
    read = events.with_arrival_order(spark.read.text(folder))
    return running_total(read, [], "seq", [], F.lit(1).cast("bigint"), "place").select("place", F.col("value").alias("line"))


@register(
    "source_last_decisions",
    """SELECT seq, step::BIGINT AS step, row_no::BIGINT AS row_no, pos::BIGINT AS pos, action, rule_id FROM decisions
        ORDER BY ts::DATE DESC, seq DESC, step DESC, row_no DESC, pos DESC LIMIT 500""",
)
def _(spark, sf_dir):
    """The end of a log by day: only its newest folders are read."""
    folder = fresh_folder(spark, "decisions")
    decision_log.append_decisions(V.decisions_log(spark, sf_dir).drop("ts_date"), folder)
    read = decision_log.read_last_decisions(spark, folder, 500)
    return read.select("seq", big("step"), big("row", "row_no"), big("pos"), "action", "rule_id")


@register(
    "source_decisions_of_days",
    """SELECT seq, step::BIGINT AS step, row_no::BIGINT AS row_no, pos::BIGINT AS pos, action, rule_id FROM decisions
        WHERE ts::DATE IN (SELECT ts::DATE FROM events WHERE event_id % 997 = 5)""",
)
def _(spark, sf_dir):
    """The days come from another table and prune the folders of the log while the query runs."""
    folder = fresh_folder(spark, "decisions")
    decision_log.append_decisions(V.decisions_log(spark, sf_dir).drop("ts_date"), folder)
    days = V.table(spark, sf_dir, "events").where("event_id % 997 = 5").select(F.to_date("ts").alias("ts_date")).distinct()
    read = decision_log.read_decisions_of(spark, folder, materialize(days, "days"))
    return read.select("seq", big("step"), big("row", "row_no"), big("pos"), "action", "rule_id")
