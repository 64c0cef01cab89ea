"""Streams over several batches give what the batch operators give."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from stmtgauge.operators import correct, decisions, metrics, packets, policy, profiles
from stmtgauge.sources.rules import RULE_SCHEMA
from stmtgauge.streaming import jobs, state, stateful

RULES = [
    (0, "orders", "pattern", "into dbo.orders", "block", "o", 0.9, True, None, 25),
    (1, "phone", "column", "Phone", "autocorrect", "p", 0.9, True, None, 0),
]
TEXTS = [
    "insert into dbo.orders (a) values (1)",
    "INSERT INTO dbo.C (Name,Phone) VALUES ('A', '070-1')",
    "SELECT Id, x FROM dbo.C where 1",
    "SELECT * FROM dbo.C",
    "UPDATE dbo.C SET Phone = '' WHERE id = 1",
    None,
]


def log_files(spark, folder, n_files=3, per_file=60, seed=0, first=0):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    seq = first
    for _ in range(n_files):
        rows = []
        for _ in range(per_file):
            rows.append((seq, start + datetime.timedelta(seconds=seq * 7), rng.choice(TEXTS), rng.random() * 300))
            seq += 1
        df = spark.createDataFrame(rows, "seq BIGINT, ts TIMESTAMP, sql_text STRING, value DOUBLE")
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def stream_of(spark, folder, table):
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, tmp_path, mode="append"):
    """Collect a stream's rows with their batch."""
    rows = []

    def keep(df, batch_id):
        rows.extend((batch_id, r) for r in df.collect())

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return rows


def test_decisions(spark, tmp_path):
    folder = str(tmp_path / "in")
    table, rules = log_files(spark, folder), spark.createDataFrame(RULES, RULE_SCHEMA)
    for form in ("compiled", "join"):
        expected = {r.seq: r.decision for r in policy.decide(table, rules, form=form).collect()}
        rows = run(jobs.stream_decisions(stream_of(spark, folder, table), rules, form=form), tmp_path / form)
        assert {r.seq: r.decision for _, r in rows} == expected
        assert {b for b, _ in rows} == {0, 1, 2}


def test_counters(spark, tmp_path):
    folder = str(tmp_path / "in")
    table, rules = log_files(spark, folder), spark.createDataFrame(RULES, RULE_SCHEMA)
    log = correct.statement_decisions(stream_of(spark, folder, table), rules)
    latest = {r.key: r.n for _, r in run(jobs.stream_counters(log), tmp_path, "update")}
    batch = decisions.counters(decisions.counter_increments(correct.statement_decisions(table, rules)))
    assert latest == {r.key: r.n for r in batch.collect()}


def to_table(spark, stream, out, check):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_threshold_gate(spark, tmp_path):
    """Over twenty batches with a restart in between, hits of every row and gates as in one batch."""
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rules = spark.createDataFrame([*RULES, (2, "sel", "pattern", "from dbo.C", "block", "s", 0.9, True, None, 90)], RULE_SCHEMA)
    make = lambda df: correct.statement_decisions(df, rules).unionByName(correct.cell_corrections(df, rules, mode="enforce"))
    for part in range(2):
        log_files(spark, folder, 10, 15, part, first=150 * part)
        table = spark.read.parquet(folder)
        gates = stateful.stream_gates(make(stream_of(spark, folder, table)), rules, salts=3, bits=4)
        to_table(spark, gates, out, check)
    rows = lambda df: sorted(map(tuple, df.collect()))
    table = spark.read.parquet(folder)
    got, want = spark.read.parquet(out), correct.apply_thresholds(make(table), rules)
    assert rows(got) == rows(want) and got.count() > 100 and {r.enforced for r in got.collect()} == {True, False}


def packet_files(spark, folder, conns, n_files, per_file, seed, first=0):
    rng, seq = random.Random(seed), first
    start = datetime.datetime(2024, 1, 1)
    for _ in range(n_files):
        rows = []
        for _ in range(per_file):
            payload = "".join(rng.choice("abcå") for _ in range(rng.randint(0, 3))).encode("utf-16-le")
            kind, end = rng.choice([1, 3, 3, 4]), rng.random() < 0.4
            head = bytes([kind, end, *(8 + len(payload)).to_bytes(2, "big"), 0, 7, 1, 0])
            rows.append((rng.choice(conns), seq, start + datetime.timedelta(seconds=seq), bytearray(head + payload)))
            seq += 1
        df = spark.createDataFrame(rows, "conn_id BIGINT, seq BIGINT, ts TIMESTAMP, bytes BINARY")
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def test_reassembly(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in range(2):
        table = packet_files(spark, folder, [1, 2, 3, None], 6, 25, part, first=150 * part)
        to_table(spark, stateful.stream_messages(stream_of(spark, folder, table)), out, check)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(spark.read.parquet(out)) == rows(packets.reassemble_messages(spark.read.parquet(folder))) and spark.read.parquet(out).count() > 60


def test_parts_without_an_end_go(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for n in range(8):  # each file has connections of its own, most of which break off
        table = packet_files(spark, folder, range(20 * n, 20 * n + 20), 1, 30, n, first=1000 * n)
    query = to_table(spark, stateful.stream_messages(stream_of(spark, folder, table), "ts", "1 second", 60), out, check)
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert len(held) >= 8 and max(held) <= 2 * 40 and held[-1] <= 40
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(spark.read.parquet(out)) == rows(packets.reassemble_messages(table))


def test_rates_and_quantiles(spark, tmp_path):
    folder = str(tmp_path / "in")
    table = log_files(spark, folder)
    stream = stream_of(spark, folder, table)
    rates = {r.window_start: round(r.per_second, 9) for _, r in run(jobs.stream_rate(stream, "ts", "value"), tmp_path / "r", "update")}
    assert rates == {r.window_start: round(r.per_second, 9) for r in metrics.rate(table, "ts", "value").collect()}
    found = run(jobs.stream_quantile(stream, "ts", "value"), tmp_path / "q", "update")
    expected = metrics.windowed_quantile(table, "ts", "value").collect()
    assert {r.window_start: (r["count"], round(r.quantile, 9)) for _, r in found} == {
        r.window_start: (r["count"], round(r.quantile, 9)) for r in expected
    }


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    for rows in ([(at(1), 60.0)], [(at(30), 60.0)], [(at(31), 60.0)], [(at(1), 60.0), (at(32), 60.0)]):
        spark.createDataFrame(rows, "ts TIMESTAMP, value DOUBLE").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("ts TIMESTAMP, value DOUBLE").option("maxFilesPerTrigger", 1).parquet(folder)
    rows = run(jobs.stream_rate(stream, "ts", "value"), tmp_path, "update")
    assert {(r.window_start, r.per_second) for _, r in rows} == {(at(1), 1.0), (at(30), 1.0), (at(31), 1.0), (at(32), 1.0)}


def test_incremental_profiles(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    table = log_files(spark, folder, 5)
    job = jobs.profile_batches(state, str(tmp_path / "report"), every=2)
    jobs.run_incremental(stream_of(spark, folder, table), job, str(tmp_path / "check"))
    rows = lambda df: {r.field: (r["count"], r.nulls, r.suggestions) for r in df.collect()}
    assert rows(jobs.profile_log(state, 2).before(spark, 5)) == rows(profiles.field_profiles(table))
    usage = jobs.usage_log(state, 2).before(spark, 5)
    assert {tuple(r) for r in usage.collect()} == {tuple(r) for r in profiles.select_usage(table).collect()}
    text = spark.read.text(str(tmp_path / "report" / "batch=2")).collect()
    assert text[0].value == "# Daily Data Quality Report – 2024-01-01"


def test_a_change_log_writes_changes_only(spark, tmp_path):
    add = lambda a, b: a.unionByName(b).groupBy("k").agg(F.sum("n").alias("n"))
    log = state.ChangeLog(str(tmp_path / "log"), "k BIGINT, n BIGINT", add, every=3)
    change = lambda b: spark.createDataFrame([(b % 4, 1), (100 + b, b)], "k BIGINT, n BIGINT")
    rows = lambda df: {r.k: r.n for r in df.collect()}
    want: dict = {}
    for b in range(14):
        assert rows(log.before(spark, b)) == want
        for _ in range(1 + (b % 5 == 0)):  # some batches are repeated
            log.append(change(b), b)
            assert rows(log.before(spark, b)) == want
        for k, n in ((b % 4, 1), (100 + b, b)):
            want[k] = want.get(k, 0) + n
        assert spark.read.parquet(str(tmp_path / "log" / "changes" / f"batch={b}")).count() == 2
        assert len(list((tmp_path / "log" / "changes").iterdir())) <= 6
    assert rows(log.before(spark, 14)) == want


def test_rules_that_change_while_a_stream_runs(spark, tmp_path):
    """A change between two batches, and a late event: each meets the rule of its time."""
    folder, known = str(tmp_path / "in"), str(tmp_path / "rules")
    day = lambda n: datetime.datetime(2024, 1, n)
    schema = f"{RULE_SCHEMA}, valid_from TIMESTAMP, valid_to TIMESTAMP"
    first = (0, "old", "pattern", "from", "block", "", 1.0, True, None, 0, None, None)
    spark.createDataFrame([first], schema).write.parquet(known)
    for n, rows in enumerate(([(1, day(1))], [(2, day(5)), (3, day(2))], [(4, day(9))])):
        df = spark.createDataFrame([(i, t, "select a from b") for i, t in rows], "seq BIGINT, ts TIMESTAMP, sql_text STRING")
        df.coalesce(1).write.mode("append").parquet(folder)
    seen = {}

    def sink(df, batch_id):
        seen.update({r.seq: r.decision.rule_id for r in df.collect()})
        if batch_id == 0:  # from the fourth on another rule is in force
            rows = [(*first[:-1], day(4)), (1, "new", *first[2:-2], day(4), None)]
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(known)

    job = jobs.decisions_of_their_time(lambda: spark.read.schema(schema).parquet(known), sink)
    stream = spark.readStream.schema("seq BIGINT, ts TIMESTAMP, sql_text STRING").option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.run_incremental(stream, job, str(tmp_path / "check"))
    assert seen == {1: "old", 2: "new", 3: "old", 4: "new"}
