"""Decision log, corrections, thresholds and outcomes."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stmtgauge.operators import correct, decisions, rpc, shred
from stmtgauge.operators.running import running_total
from stmtgauge.sources.rules import RULE_SCHEMA

RULES = [
    (0, "phone", "column", "Phone", "autocorrect", "p", 0.9, True, None, 0),
    (1, "orders", "pattern", "into dbo.orders", "block", "o", 0.9, True, None, 3),
    (2, "drop", "pattern", "drop table", "block", "d", 1.0, True, None, 0),
    (3, "items", "table", "dbo.items", "autocorrect", "i", 0.7, True, None, 0),
]


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def test_running_total_matches_a_plain_sum(spark):
    rng = random.Random(1)
    # One hot key; order values close together, far apart, repeated and negative.
    orders = [rng.choice([rng.randint(0, 300), rng.randint(0, 2**40), -rng.randint(0, 2**35), 65536 * rng.randint(0, 9)]) for _ in range(3000)]
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), seq, tie, rng.randint(0, 1)) for tie, seq in enumerate(orders)]
    df = spark.createDataFrame(rows, "k STRING, seq BIGINT, tie INT, v INT")
    got = running_total(df, ["k"], "seq", ["tie"], F.col("v"), "run", total="all")
    sums, expected = Counter(), {}
    for k, seq, tie, v in sorted(rows, key=lambda r: (r[1], r[2])):
        sums[k] += v
        expected[tie] = sums[k]
    assert {r.tie: (r.run, r.all) for r in got.collect()} == {t: (expected[t], sums[k]) for k, _, t, _ in rows}


def test_cells_and_corrected_text(statements, rules):
    df = statements(
        "INSERT INTO dbo.C (Name,Phone) VALUES ('A', '070-1'), ('B', '+461')",
        "UPDATE dbo.C SET Phone = '0702', Note = 'it''s' WHERE id = 1",
        "INSERT INTO dbo.C (Phone) VALUES ('1', '2')",
        "INSERT INTO dbo.items (Price,Note) VALUES ('1,5', NULL)",
        "insert into dbo.orders (phone) values ('070')",
    )
    log = correct.cell_corrections(df, rules, mode="log")
    got = sorted((r.seq, r.row, r.pos, r.column, r.before, r.after, r.rule_id) for r in log.collect())
    assert got == [
        (0, 0, 1, "dbo.C.Phone", "070-1", "+4670-1", "phone"),
        (1, 0, 0, "dbo.C.Phone", "0702", "+46702", "phone"),
        (3, 0, 0, "dbo.items.Price", "1,5", "1.5", "items"),
        (4, 0, 0, "dbo.orders.phone", "070", "+4670", "phone"),
    ]
    enforced = correct.cell_corrections(df, rules, mode="enforce")
    assert {r.seq for r in enforced.collect()} == {0, 1, 3}
    texts = {r.seq: r.corrected for r in correct.corrected_statements(df, enforced).collect()}
    assert texts == {
        0: "INSERT INTO dbo.C (Name,Phone) VALUES ('A', '+4670-1'), ('B', '+461')",
        1: "UPDATE dbo.C SET Phone = '+46702', Note = 'it''s' WHERE id = 1",
        3: "INSERT INTO dbo.items (Price,Note) VALUES (1.5, NULL)",
    }
    compat = {r.seq: r.corrected for r in correct.corrected_statements(df, enforced, compat=True).collect()}
    assert compat[3] == "INSERT INTO dbo.items (Price,Note) VALUES (1.5, 'NULL')"


def full_log(df, rules, mode):
    return correct.statement_decisions(df, rules).unionByName(correct.cell_corrections(df, rules, mode=mode))


def test_thresholds_and_outcomes(statements, rules, spark):
    order = "insert into dbo.orders (a) values (1)"
    df = statements(order, "drop table x", order, "INSERT INTO c (Phone) VALUES ('070')", order, order, "select 1", "")
    log = full_log(df, rules, "enforce")
    gates = {r.seq: (r.rule_id, r.hits, r.enforced) for r in correct.apply_thresholds(log, rules).collect()}
    assert gates == {0: ("orders", 1, False), 1: ("drop", None, True), 2: ("orders", 2, False), 4: ("orders", 3, True), 5: ("orders", 4, True)}
    outcomes = {r.seq: r.outcome for r in correct.statement_outcomes(log, rules, "enforce").collect()}
    assert outcomes == {0: "gated", 1: "blocked", 2: "gated", 3: "rewritten", 4: "blocked", 5: "blocked", 6: "forwarded"}
    logged = correct.statement_outcomes(full_log(df, rules, "log"), rules, "log")
    assert {r.outcome for r in logged.collect()} == {"forwarded"}
    earlier = spark.createDataFrame([("orders", "block", 1), ("orders", "rpc_autocorrect_inplace", 1), ("orders", "allow", 9)], "rule_id STRING, action STRING, n BIGINT")
    gates = {r.seq: r.enforced for r in correct.apply_thresholds(log, rules, earlier).collect() if r.rule_id == "orders"}
    assert gates == {0: True, 2: True, 4: True, 5: True}


def test_thresholds_on_a_hot_rule_match_a_plain_count(spark, rules):
    rng = random.Random(2)
    rows = [(i * rng.choice([1, 70000]) + i, rng.random() < 0.6) for i in range(2000)]
    seqs = sorted({s for s, _ in rows})
    log = spark.createDataFrame([(s, s % 3 != 0) for s in seqs], "seq BIGINT, hit BOOLEAN").select(
        "seq", F.lit(0).alias("step"), F.when(F.col("hit"), "block").otherwise("allow").alias("action"),
        F.when(F.col("hit"), "orders").alias("rule_id"),
    )
    got = {r.seq: r.hits for r in correct.apply_thresholds(correct.as_log(log), rules).collect()}
    assert got == {s: n + 1 for n, s in enumerate(s for s in seqs if s % 3 != 0)}


def test_statement_log_counters_and_sniffing(statements, rules, spark):
    df = statements("insert into dbo.orders (a) values (1)", "SELECT 1", "x" * 300, None)
    log = correct.statement_decisions(df, rules)
    rows = {r.seq: (r.action, r.rule_id, len(r.sample)) for r in log.collect()}
    assert rows == {0: ("block", "orders", 37), 1: ("allow", None, 8), 2: ("allow", None, 200)}
    counters = decisions.counters(decisions.counter_increments(log))
    assert [tuple(r) for r in counters.collect()] == [("rule:orders:block", "orders", "block", 1)]
    assert [tuple(r) for r in decisions.rule_counters(counters, "orders").collect()] == [("block", 1)]
    sniffed = {r.key: r.n for r in correct.sniff_counters(df, rules).collect()}
    assert sniffed == {"blocks": 1, "allowed": 1}
    sizes = correct.oversized_rewrites(df.where("seq < 3"), "sql_text", cap=8 + 2 * 37)
    assert {r.seq: r.rewrite_skipped_size for r in sizes.collect()} == {0: False, 1: False, 2: True}


def test_calls(statements, spark):
    rows = [
        (0, "phone", "column", "@phone", "autocorrect", "p", 0.9, True, None, 0),
        (1, "id", "column", "id", "block", "i", 0.9, True, None, 0),
    ]
    rules = spark.createDataFrame(rows, RULE_SCHEMA)
    df = statements(
        "dbo.P @Phone='070 1', @Id='7'",
        "dbo.P @Phone='0701', @Note='0701'",
        "dbo.P @Phone='070 - 1', @Note='x'",
        "dbo.P @Phone=7, @Other='0046 1'",
        "dbo.P @phone='070 - 1', @Phone='070 - 1'",
    )
    params = shred.rpc_params(df)
    log = rpc.param_decisions(params, rules)
    assert {(r.seq, r.param): r.action for r in log.collect()}[(0, "Id")] == "block"
    assert {r.seq: r.blocked for r in rpc.call_outcomes(log, "enforce").collect()} == {0: True, 1: False, 2: False, 3: False, 4: False}
    fixed = rpc.fixed_width_corrections(df, params, rules)
    got = sorted((r.seq, r.pos, r.after, r.written, r.corrected_text) for r in fixed.collect())
    both = "dbo.P @phone='+4670-1 ', @Phone='+4670-1 '"
    assert got == [
        (2, 0, "+4670-1", "+4670-1", "dbo.P @Phone='+4670-1', @Note='x'"),
        (3, 0, "+461", "+461  ", "dbo.P @Phone=7, @Other='+461  '"),
        (4, 0, "+4670-1", "+4670-1", both.replace(" '", "'")),
        (4, 1, "+4670-1", "+4670-1", both.replace(" '", "'")),
    ]
    cut = {r.seq: (r.written, r.truncated) for r in rpc.fixed_width_corrections(df, params, rules, truncate=True).collect()}
    assert cut[1] == ("+467", True)
    assert {r.action for r in rpc.inplace_log(fixed).collect()} == {"rpc_autocorrect_inplace"}
    types = spark.createDataFrame([("dbo.p", "id", "INT"), ("dbo.p", "note", "money")], "proc STRING, param STRING, type STRING")
    typed = {(r.seq, r.name): r.type for r in rpc.param_types(params, types).collect()}
    assert typed[(0, "Id")] == "int" and typed[(1, "Note")] == "nvarchar" and typed[(0, "Phone")] == "nvarchar"


def test_samples_keep_few_rows_per_task(spark):
    df = spark.createDataFrame([(i, "r", "s", None) for i in range(10)], "seq BIGINT, rule_id STRING, sample STRING, before STRING")
    found = decisions.samples_by_rule(df, decisions.first_sample(), ("seq",))
    assert found.count() == 3
    assert "WindowGroupLimit" in found._jdf.queryExecution().optimizedPlan().toString()


def test_day_dashboard(spark):
    rows = [(0, "2024-01-01", "a", "Block"), (1, "2024-01-02", "a", "block"), (2, "2024-01-02", None, "allow"), (3, "2024-01-02", "b", "block")]
    df = spark.createDataFrame(rows, "seq BIGINT, d STRING, rule_id STRING, action STRING").withColumn("ts_date", F.col("d").cast("date"))
    board = lambda **kw: sorted(tuple(r) for r in decisions.day_dashboard(df, "2024-01-02", **kw).collect())
    assert board() == [("(no_rule)", "allow", 1), ("a", "block", 1), ("b", "block", 1)]
    assert board(rule="a", action="block") == [("a", "block", 1)]
    assert board(action="Block") == []
    assert board(last_n=2) == [("(no_rule)", "allow", 1), ("b", "block", 1)]
    assert [r.seq for r in decisions.tail(df, 2, ("seq",)).collect()] == [2, 3]
