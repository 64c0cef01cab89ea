"""Readers and writers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from stmtgauge.operators import policy, profiles
from stmtgauge.sources import decisions, events, reports, rules, storage
from stmtgauge.sources import profiles as snapshots

RULE = {"id": "a", "target": "column", "selector": "X", "action": "block", "reason": "r", "confidence": 0.5}


def test_query_events(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    line = lambda text: json.dumps({"timestamp": "2024-01-02T03:04:05Z", "sql_text": text, "duration_ms": 7, "user": "u"})
    (folder / "20240102.jsonl").write_text("\n".join([line("c"), "broken", "5", line("d")]) + "\n")
    (folder / "20240101.jsonl").write_text("\n".join([line("a"), "", line("b"), '["x"]']) + "\n")
    df = events.read_query_events(spark, str(folder))
    got = df.orderBy("seq").collect()
    assert [r.sql_text for r in got if r.sql_text] == ["a", "b", "c", "d"]
    assert got[0].ts.isoformat() == "2024-01-02T03:04:05" and got[0].duration_ms == 7
    events.write_query_events(df.where("sql_text IS NOT NULL"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "day=20240102").is_dir()
    again = events.read_json_lines(spark, str(tmp_path / "out"), events.EVENT_FIELDS)
    assert again.count() == 4


def test_line_order_over_splits(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    n = 0
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        lines = []
        for _ in range(400):
            lines.append(json.dumps({"sql_text": str(n), "value": "x" * (n % 50)}))
            n += 1
        (folder / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = events.read_policy_events(spark, str(folder))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 6
        rows = df.orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.sql_text for r in rows] == [str(i) for i in range(n)]
    assert len({r.seq for r in rows}) == n


def test_event_xml(spark, tmp_path):
    xml = """<RingBufferTarget>
      <event name="sql_batch_completed" timestamp="2024-01-02T03:04:05.000Z">
        <data name="duration"><value>12</value></data><data name="row_count" value="3"/>
        <data name="statement" value="select 1"/><data name="batch_text"><value>select 2</value></data>
        <action name="username" value="me"/><action name="database_name"><value>db</value></action>
        <action name="client_app_name" value="old"/><action name="client_app_name" value="app"/>
      </event>
      <event name="error_reported" timestamp="2024-01-02T03:04:06.000Z"><data name="error" value="x"/></event>
    </RingBufferTarget>"""
    (tmp_path / "ring.xml").write_text(xml)
    one, two = events.read_event_xml(spark, str(tmp_path / "ring.xml")).orderBy("timestamp").collect()
    assert (one.event, one.sql_text, one.duration_ms, one.row_count, one.user, one.database, one.client_app) == (
        "sql_batch_completed", "select 2", 12, 3, "me", "db", "app",
    )
    assert (two.event, two.error, two.sql_text, two.user) == ("error_reported", None, None, None)


def test_rules(spark, tmp_path):
    path = tmp_path / "rules.json"
    entries = [
        RULE, {**RULE, "id": "b", "apply_in_envs": ["dev"], "min_hits_to_enforce": 10}, {**RULE, "id": "c", "target": "row"},
        {**RULE, "id": "d", "action": "BLOCK", "selector": 5}, {**RULE, "id": "e", "enabled": False}, {"target": "table"},
    ]
    path.write_text(json.dumps(entries, indent=1))
    got = {r.id: r for r in rules.read_rules(spark, str(path)).collect()}
    assert {"a", "b", "e"} <= set(got) and "c" not in got
    assert got["b"].apply_in_envs == ["dev"] and got["b"].min_hits_to_enforce == 10 and got["b"].ord == 1
    assert {r.id for r in rules.read_rules(spark, str(path), compat=True).collect()} >= {"a", "e"}
    assert "b" not in {r.id for r in rules.read_rules(spark, str(path), compat=True).collect()}
    assert rules.read_rules(spark, str(tmp_path / "none.json")).count() == 0
    errors = {r.ord: r.error for r in policy.validate_rules(rules.read_raw_rules(spark, str(path))).collect()}
    assert errors == {
        2: "target must be one of ['column', 'pattern', 'table']", 3: "selector must be a non-empty string",
        5: "id must be a non-empty string",
    }


def test_param_types(spark, tmp_path):
    path = tmp_path / "types.json"
    path.write_text(json.dumps({"dbo.Proc": {"@Name": "NVARCHAR", "id": "INT"}}))
    got = {(r.proc, r.param, r.type) for r in rules.read_param_types(spark, str(path)).collect()}
    assert got == {("dbo.proc", "name", "NVARCHAR"), ("dbo.proc", "id", "INT")}
    path.write_text("nonsense")
    assert rules.read_param_types(spark, str(path)).count() == 0
    assert rules.read_param_types(spark, str(tmp_path / "none")).count() == 0


def test_decision_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(1, "2024-01-01 10:00:00", "block"), (2, "2024-01-02 10:00:00", "allow"), (3, None, "allow")]
    df = spark.createDataFrame(rows, "seq BIGINT, t STRING, action STRING").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    decisions.append_decisions(df, path)
    decisions.append_decisions(df.where("seq = 2"), path)
    assert decisions.read_decisions(spark, path).count() == 4
    day = decisions.read_decisions(spark, path, "2024-01-02")
    assert [(r.seq, r.action) for r in day.collect()] == [(2, "allow"), (2, "allow")]
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ts_date" in plan
    stamped = decisions.read_decisions(spark, path).where("seq = 3").first()
    assert stamped.ts is not None and stamped.ts_date is not None
    plain = tmp_path / "decisions.jsonl"
    plain.write_text('{"ts": "2024-01-05T00:00:01", "action": "block", "rule_id": "r"}\nbroken\n{"ts": "2024-01-06T00:00:01", "action": "allow"}\n')
    got = decisions.read_decisions(spark, str(plain)).orderBy("seq").collect()
    assert [(str(r.ts_date), r.action) for r in got] == [("2024-01-05", "block"), ("2024-01-06", "allow")]
    assert decisions.read_decisions(spark, str(plain), "2024-01-06").count() == 1


def test_profile_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    log = spark.createDataFrame([("INSERT INTO t (a,b) VALUES ('070', NULL)",)], "sql_text STRING")
    table = profiles.field_profiles(log)
    snapshots.write_snapshot(table, path, "2024-01-01")
    snapshots.write_snapshot(table, path, "2024-01-01")
    got = {r.field: (r["count"], r.nulls, r.suggestions) for r in snapshots.read_snapshot(spark, path, "2024-01-01").collect()}
    assert got == {"t.a": (1, 0, {"phone": 1}), "t.b": (1, 1, {})}
    assert {r.nulls for r in profiles.field_profiles(log, count_nulls=False).collect()} == {0}
    assert snapshots.read_snapshot(spark, path, "2023-01-01").count() == 0
    field = {"count": 5, "nulls": 1, "values": {}, "suggestions": {"date": 2}}
    for text in ({"profiles": {"t.x": field}, "selects": {"t": {"star": 1, "columns": {"a": 2}}}}, {"t.x": field}):
        (tmp_path / "p.json").write_text(json.dumps(text))
        fields, selects = snapshots.read_profiles_json(spark, str(tmp_path / "p.json"))
        assert [tuple(r) for r in fields.collect()] == [("t.x", 5, 1, {"date": 2})]
        assert [tuple(r) for r in selects.collect()] == ([("t", 1, {"a": 2})] if "selects" in text else [])


def test_report_keeps_its_order(spark, tmp_path):
    rows = [(s, p, "", 0, f"{s}.{p}") for s in range(3) for p in range(50)]
    df = spark.createDataFrame(rows[::-1], "section INT, place BIGINT, name STRING, sub INT, line STRING").repartition(6)
    reports.write_report(df, str(tmp_path / "r"))
    files = sorted((tmp_path / "r").glob("part-*"))
    assert "".join(f.read_text() for f in files).split() == [r[4] for r in rows]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    folder = spark.conf.get(storage.CHECKPOINT_DIR)
    assert storage.shared_folder(spark) == folder
    assert storage.materialize(spark.range(5)).count() == 5
    with pytest.raises(Exception):
        storage.if_present(lambda: spark.sql("SELECT nothing"))


def test_every_object_is_kept(spark, tmp_path):
    lines = ['{"sql_text": "a", "duration_ms": 12.5}', '{"sql_text": "b", "duration_ms": "fast"}', '{"sql_text": 7, "row_count": "8"}',
             '{"sql_text": {"x": 1}, "error": true}', "{}", ' \t{"sql_text": "c", "duration_ms": null}', "7", "[]", '"x"', "nonsense", "", '{"sql_text": "d"']
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(lines))
    got = events.read_query_events(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert [(r.sql_text, r.duration_ms, r.row_count) for r in got] == [
        ("a", 12, None), ("b", None, None), ("7", None, 8), ('{"x":1}', None, None), (None, None, None), ("c", None, None)
    ]


def test_days_are_utc(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01T23:30:00Z",)], "t STRING").select(F.col("t").cast("timestamp").alias("ts"), F.lit("x").alias("sql_text"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Stockholm")
    try:
        events.write_query_events(df, str(tmp_path / "e"))
        decisions.append_decisions(df.withColumn("action", F.lit("block")), str(tmp_path / "d"))
        assert [p.name for p in (tmp_path / "e").iterdir() if p.name.startswith("day")] == ["day=20240101"]
        assert decisions.read_decisions(spark, str(tmp_path / "d"), "2024-01-01").count() == 1
        assert decisions.read_decisions(spark, str(tmp_path / "d"), "2024-01-02").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rules_in_several_files_keep_their_order(spark, tmp_path):
    folder = tmp_path / "rules"
    folder.mkdir()
    names = [f"r{i}" for i in range(23)]
    for k in range(0, 23, 5):
        (folder / f"{k:03}.json").write_text(json.dumps([{**RULE, "id": n} for n in names[k : k + 5]]))
    (folder / "012.json").write_text("[]")
    for read in (rules.read_rules, rules.read_raw_rules):
        assert [(r.ord, r.id.strip('"')) for r in read(spark, str(folder)).orderBy("ord").collect()] == list(enumerate(names))


def events_of(spark, rows):
    return spark.createDataFrame(rows, "ts TIMESTAMP, event STRING, row_count BIGINT, seq BIGINT")


def at(minute):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_a_source_read_again_and_a_killed_sink(spark, tmp_path):
    """Every turn repeats the last ones; the sink is stopped in between and its last commit lost once."""
    raw, out, check = (str(tmp_path / n) for n in ("raw", "out", "check"))
    held = []
    for part in range(3):
        for turn in range(4 * part, 4 * part + 4):
            rows = [(at(400 * t + i), "e", 100 * t + i, turn) for t in (turn - 1, turn) if t >= 0 for i in range(20)]
            events_of(spark, [*rows, (None, "no time", turn, 0)]).coalesce(1).write.mode("append").parquet(raw)
        stream = spark.readStream.schema("ts TIMESTAMP, event STRING, row_count BIGINT, seq BIGINT").option("maxFilesPerTrigger", 1).parquet(raw)
        query = events.sink_query_events(events.without_repeats(stream, "10 minutes"), out, check)
        held += [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        if part == 0:  # the query is killed after its sink has written a batch and before it is marked as done
            last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
            last.unlink()
            (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    read = spark.read.schema("event STRING, row_count BIGINT, day STRING").json(out)
    got = sorted(r.row_count for r in read.where("event = 'e'").collect())
    assert got == sorted(100 * t + i for t in range(12) for i in range(20))
    assert read.where("event = 'no time'").count() == 12 and max(held) <= 60
    assert {r.day for r in read.where("event = 'e'").select("day").distinct().collect()} == {"20240101", "20240102", "20240103", "20240104"}
    batch = events_of(spark, [(at(1), "e", 1, 5), (at(1), "e", 1, 6), (at(1), "e", 2, 7), (None, "n", 1, 8), (None, "n", 1, 9)])
    assert events.without_repeats(batch).count() == 4


def test_the_end_of_a_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = [(i, at(60 * i), "allow", f"r{i % 3}") for i in range(100)]
    log = spark.createDataFrame(rows, "seq BIGINT, ts TIMESTAMP, action STRING, rule_id STRING").withColumn("step", F.lit(0))
    assert decisions.read_last_decisions(spark, folder, 5).collect() == []
    decisions.append_decisions(log, folder)
    for n in (1, 10, 24, 25, 99, 1000):
        found = decisions.read_last_decisions(spark, folder, n)
        assert sorted(r.seq for r in found.collect()) == list(range(max(0, 100 - n), 100))
        days = {f.split("ts_date=")[1].split("/")[0] for f in found.inputFiles()}
        assert len(days) == min(5, 1 + max(0, n - 4 + 23) // 24)


def test_days_of_a_table_prune_the_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    log = spark.createDataFrame([(i, at(60 * i), "allow") for i in range(100)], "seq BIGINT, ts TIMESTAMP, action STRING")
    decisions.append_decisions(log.withColumn("step", F.lit(0)), folder)
    spark.createDataFrame([("2024-01-02",), ("2024-01-04",), ("2030-01-01",), (None,)], "d STRING").select(
        F.col("d").cast("date").alias("ts_date")
    ).write.parquet(str(tmp_path / "days"))
    found = decisions.read_decisions_of(spark, folder, spark.read.parquet(str(tmp_path / "days")))
    assert sorted(r.seq for r in found.collect()) == [*range(24, 48), *range(72, 96)]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_bucketed_snapshots_join_without_exchange(spark, tmp_path):
    path = str(tmp_path / "snap")
    table = lambda n: spark.range(300).selectExpr("concat('t.', id) AS field", "10L AS count", f"id % {n} AS nulls", "map('date', id) AS suggestions")
    assert snapshots.read_bucketed_snapshot(spark, path, "2024-01-01").count() == 0
    for day, n in (("2024-01-01", 5), ("2024-01-01", 3), ("2024-01-02", 7)):  # the second replaces the first
        snapshots.write_bucketed_snapshot(table(n), path, day)
    before, after = (snapshots.read_bucketed_snapshot(spark, path, d) for d in ("2024-01-01", "2024-01-02"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        drift, diff = profiles.null_drift(before, after, 0.3), policy.snapshot_diff(before.drop("suggestions"), after.drop("suggestions"), "field")
        rows = sorted(map(tuple, drift.collect()))
        assert rows == sorted(map(tuple, profiles.null_drift(table(3), table(7), 0.3).collect())) and rows
        assert diff.count() == policy.snapshot_diff(table(3).drop("suggestions"), table(7).drop("suggestions"), "field").count() > 0
        for df in (drift, diff):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "hashpartitioning" not in plan and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
