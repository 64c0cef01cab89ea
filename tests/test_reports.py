"""Drift, rankings, histograms, reports and the registered queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import catalog
from stmtgauge.operators import decisions as D
from stmtgauge.operators import metrics, profiles
from stmtgauge.plans import reports

PROFILE = "field STRING, count BIGINT, nulls BIGINT, suggestions MAP<STRING, BIGINT>"
DATA = "/root/testdata/sf0.001"


def lines(df):
    return [r.line for r in df.orderBy("section", "place", "name", "sub").collect()]


def test_drift(spark):
    old = spark.createDataFrame([("a", 100, 5, {}), ("gone", 10, 5, {}), ("zero", 0, 0, {})], PROFILE)
    new = spark.createDataFrame([("a", 100, 25, {}), ("new", 0, 1, {}), ("zero", 9, 0, {})], PROFILE)
    got = [(r.field, round(r.drift, 6)) for r in profiles.null_drift(old, new).collect()]
    assert got == [("new", 1.0), ("gone", 0.5), ("a", 0.2)]


def test_daily_report(spark):
    table = spark.createDataFrame([("t.a", 9, 3, {"phone": 2, "date": 1}), ("t.b", 4, 0, {})], PROFILE)
    usage = spark.createDataFrame([("t", None, 0, 2), ("t", "x", 3, 0), ("t", "y", 5, 0)], "table STRING, expression STRING, n BIGINT, star BIGINT")
    before = spark.createDataFrame([("t.a", 9, 0, {})], PROFILE)
    assert lines(reports.daily_report(spark, "D", table, usage, before)) == [
        "# Daily Data Quality Report – D", "", "## Top Missingness", "- t.a: nulls=3 / count=9", "- t.b: nulls=0 / count=4", "",
        "## Format Issues & Suggestions", "- t.a: 3 suggestions (date:1, phone:2)", "- t.b: 0 suggestions ()", "", "## SELECT Analysis",
        "- t: select_star=2, top_columns=[y:5, x:3]", "", "## Drift & Errors", "- t.a: null_ratio drift 0.33",
    ]


def test_daily_report_without_selects_or_history(spark):
    table = spark.createDataFrame([("t.b", 4, 0, {})], PROFILE)
    usage = spark.createDataFrame([], "table STRING, expression STRING, n BIGINT, star BIGINT")
    assert lines(reports.daily_report(spark, "D", table, usage))[4:] == [
        "", "## Format Issues & Suggestions", "- t.b: 0 suggestions ()", "", "## Drift & Errors",
        "- TODO: compute PSI/KL and error trends once enough history is available.",
    ]


def test_dryrun_and_insights(spark):
    rows = [(0, "r", "block", "s1", None), (1, "r", "Block", "", "b\n2"), (2, None, "allow", "x" * 200, None), (3, "r", "allow", "s3", None), (4, "r", "block", "s4", None)]
    log = spark.createDataFrame(rows, "seq BIGINT, rule_id STRING, action STRING, sample STRING, before STRING")
    assert lines(reports.dryrun_report(spark, "D", log)) == [
        "# Dry‑Run Enforcement Summary – D", "", "## Totals by Action", "- block: 3", "- allow: 2", "", "## By Rule",
        "- (no_rule): allow:1", "  - sample: " + "x" * 160, "- r: block:3, allow:1", "  - sample: s1", "  - sample: b 2", "  - sample: s3",
    ]
    table = spark.createDataFrame([("t.a", 9, 3, {"phone": 2})], PROFILE)
    assert lines(reports.insight_context(spark, "D", log, table)) == [
        "Decisions by rule (today D):",
        "- (no_rule): {'block': 0, 'autocorrect': 0, 'rpc_autocorrect_inplace': 0}",
        "- r: {'block': 3, 'autocorrect': 0, 'rpc_autocorrect_inplace': 0}",
        "Top profiles:",
        "- t.a: count=9 nulls=3 sugg=2",
    ]
    assert lines(reports.profile_context(table)) == ["- t.a: count=9 nulls=3 suggestions=2"]
    assert lines(reports.profile_summary(spark, table)) == [
        "Top Missingness:", "- t.a: nulls=3 count=9", "", "Format Issues:", "- t.a: 2 suggestions",
    ]
    assert lines(reports.insight_fallback(spark, "D"))[0] == "# Insights – D"
    totals, counts = D.totals_by_action(log), D.counts_by_rule(log)
    assert lines(reports.evaluation_report(spark, "S", totals, counts))[3:5] == ["- allow: 2", "- block: 3"]


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v DOUBLE").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows = {r.le: r.cum_count for r in metrics.histogram(df, "v", metrics.LATENCY_BOUNDS_MS).collect()}
    assert rows[0.5] == 0 and rows[10.0] == 10 and rows[250.0] == 100 and rows[float("inf")] == 100
    got = metrics.windowed_quantile(df, "ts", "v", slide=None).collect()
    assert [round(r["quantile"], 6) for r in got] == [95.0]
    high = df.withColumn("v", F.col("v") + 1000)
    assert metrics.windowed_quantile(high, "ts", "v", slide=None).first()["quantile"] == 250.0


def test_contract():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 90
    # Numbered queries come with the optional training-data part only.
    assert not any(n.startswith("op") and n[2:3].isdigit() for n in catalog.QUERIES)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    totals = [r.total for r in rows]
    assert len(rows) == 8 and totals == sorted(totals, reverse=True) and totals[0] > 0
    assert all(sum(int(k.split(":")[1]) for k in r.kinds.split(", ") if k) == r.total for r in rows)


@pytest.mark.parametrize("name", ["field_profiles", "decide_by_joins", "statement_outcomes", "reassembled_messages", "suggest_normalizations", "stream_counters"])
def test_registered_query_matches_its_sql(spark, name):
    import duckdb

    import verify

    df = entry.queries()[name](spark, DATA)
    db = duckdb.connect()
    for t in verify.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert verify.rows_of(df.collect(), df.columns) == verify.rows_of(cursor.fetchall(), columns)
