"""Statement shredding against stated rows and against plain character loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stmtgauge.functions import statements as S
from stmtgauge.functions.text import split_commas_outside_quotes
from stmtgauge.operators import shred


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_and_update(statements):
    df = statements(
        "INSERT INTO dbo.T (A,[B]) VALUES ('x', '2')",
        "UPDATE dbo.T SET A = 'x', B= 2 WHERE Id=1",
        "select 1",
        None,
    )
    assert rows(shred.written_columns(df)) == [(0, "dbo.T", 0, "A"), (0, "dbo.T", 1, "B"), (1, "dbo.T", 0, "A"), (1, "dbo.T", 1, "B")]
    assert rows(shred.written_values(df)) == [(0, 0, "x"), (0, 1, "2"), (1, 0, "x"), (1, 1, "2")]
    assert rows(shred.profiled_columns(df)) == [(0, "dbo.T", "A"), (0, "dbo.T", "B"), (1, "dbo.T", "A"), (1, "dbo.T", "B")]


def test_values_by_plain_split_and_nulls(statements):
    df = statements("insert into t (a,b,c,d) values ('it''s, 5', NULL, '')", "INSERT INTO t (a) VALUES (')')")
    got = rows(shred.profiled_values(df))
    # The plain split cuts inside quotes; the list ends at the first closing parenthesis even inside quotes.
    assert got == [
        (0, "t", "a", "'it''s", False), (0, "t", "b", "5'", False), (0, "t", "c", "NULL", True), (0, "t", "d", "", True),
        (1, "t", "a", "", True),
    ]
    assert rows(shred.written_values(df))[:3] == [(0, 0, "it''s, 5"), (0, 1, "NULL"), (0, 2, "")]


def test_insert_and_update_in_one_text(statements):
    df = statements("INSERT INTO a (x) VALUES (1); UPDATE b SET y = 2, z WHERE 1=1")
    assert rows(shred.profiled_columns(df)) == [(0, "a", "x"), (0, "b", "y"), (0, "b", "z")]
    assert rows(shred.profiled_values(df)) == [(0, "a", "x", "1", False), (0, "a", "y", "2", False)]
    assert rows(shred.written_columns(df)) == [(0, "a", 0, "x")]


def test_multirow(statements):
    df = statements(
        "INSERT INTO t (a,b) VALUES ('x',1), ('y',2)",
        "insert into t (a) values (f(g(1,2)),3), (')')",
        "insert into t (a) values ) (1)",
    )
    assert rows(shred.multirow_values(df)) == [
        (0, 0, 0, "x"), (0, 0, 1, "1"), (0, 1, 0, "y"), (0, 1, 1, "2"),
        (1, 0, 0, "f(g(1"), (1, 0, 1, "2))"), (1, 0, 2, "3"), (1, 1, 0, ""),
    ]


def test_bulk_merge_select(statements):
    df = statements(
        r"BULK INSERT dbo.Customers FROM 'C:\data\cust.csv' WITH (FIELDTERMINATOR=',')",
        """MERGE INTO [dbo].[Target] AS t USING s ON t.Id = s.Id
           WHEN MATCHED THEN UPDATE SET t.[Email] = s.Email, Phone = s.Phone
           WHEN NOT MATCHED THEN INSERT (Id, [Email]) VALUES (s.Id, s.Email);""",
        "SELECT Id, Amount FROM [dbo].[Payments] WHERE x=1",
        "  select * from t",
        "SELECT  FROM t",
        "SELECT 1",
    )
    assert rows(shred.bulk_loads(df)) == [(0, "dbo.Customers", r"C:\data\cust.csv")]
    (merge,) = shred.merges(df).collect()
    assert (merge.target, merge.updated, merge.inserted) == ("dbo.Target", ["Email", "Phone"], ["Id", "Email"])
    found = {r.seq: (r.table, r.expressions, r.star) for r in shred.selects(df).collect()}
    assert found == {2: ("dbo.Payments", ["Id", "Amount"], False), 3: ("t", [], True), 4: ("t", [], False)}


def test_rpc_params(statements):
    df = statements(
        "dbo.proc @name='John', @id='42'",
        "dbo.proc @id=42, @name='x'",
        "dbo.proc @far=" + " " * 200 + "'x'",
        "dbo.proc @long='" + "y" * 121 + "'",
    )
    assert rows(shred.rpc_params(df)) == [
        (0, "dbo.proc", 0, "name", "John"), (0, "dbo.proc", 1, "id", "42"),
        (1, "dbo.proc", 0, "id", "x"), (1, "dbo.proc", 1, "name", "x"),
    ]


def test_unicode_names(statements):
    df = statements("INSERT INTO dbo.Ångström (Größe) VALUES ('é')", "UPDATE\u00a0t SET a = 1 WHERE b")
    assert rows(shred.written_columns(df)) == [(0, "dbo.Ångström", 0, "Größe"), (1, "t", 0, "a")]


def plain_split(text):
    """Walk the characters; a quote toggles, a comma outside cuts."""
    pieces, current, inside = [], "", False
    for ch in text:
        if ch == "," and not inside:
            pieces.append(current)
            current = ""
            continue
        inside ^= ch == "'"
        current += ch
    return [p.strip() for p in pieces + ([current] if current else [])]


def test_quote_aware_split_matches_the_plain_walk(spark):
    rng = random.Random(3)
    texts = {"".join(rng.choice("a', \t\x00b") for _ in range(rng.randint(0, 12))) for _ in range(2000)}
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = {r.t: r.p for r in df.select("t", split_commas_outside_quotes(F.col("t")).alias("p")).collect()}
    assert got == {t: plain_split(t) for t in texts}


def plain_groups(text):
    depth, start, groups = 0, 0, []
    for i, ch in enumerate(text):
        if ch == "(":
            depth += 1
            start = i + 1 if depth == 1 else start
        elif ch == ")":
            depth -= 1
            if depth == 0:
                groups.append(text[start:i])
    return groups


def test_groups_match_the_plain_walk(spark):
    rng = random.Random(5)
    texts = {"".join(rng.choice("(()),a") for _ in range(rng.randint(1, 14))) for _ in range(2000)}
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = {r.t: r.g for r in df.select("t", S.value_groups(F.col("t")).alias("g")).collect()}
    assert got == {t: plain_groups(t) for t in texts}


def test_long_texts_are_processed_whole(spark):
    text = ",".join(f"'v''{i}'" for i in range(60000))
    many = "INSERT INTO t (a) VALUES " + ", ".join(f"('{i}')" for i in range(20000))
    df = spark.createDataFrame([(0, text, many)], "seq BIGINT, t STRING, sql_text STRING")
    row = df.select(F.size(split_commas_outside_quotes(F.col("t"))).alias("n")).first()
    assert row.n == 60000
    assert shred.multirow_values(df).count() == 20000


def test_rewriting(spark):
    df = spark.createDataFrame(
        [("INSERT INTO dbo.T (A,B,C) VALUES ('x', '2', NULL);",)], "sql_text STRING"
    )
    sql = F.col("sql_text")
    values = F.array(F.lit("y"), F.lit("3"), F.lit(None).cast("string"))
    texts = lambda compat: F.zip_with(
        S.insert_tokens(sql), values, lambda t, v: S.rewritten_token(t, v, compat)
    )
    row = df.select(S.rebuilt_insert(sql, texts(False)).alias("a"), S.rebuilt_insert(sql, texts(True)).alias("b")).first()
    assert row.a == "INSERT INTO dbo.T (A,B,C) VALUES ('y', 3, NULL);"
    assert row.b == "INSERT INTO dbo.T (A,B,C) VALUES ('y', 3, 'NULL');"
    update = spark.createDataFrame([("UPDATE dbo.T SET A = 'it''s', B= 2 WHERE Id=1",)], "sql_text STRING")
    same = lambda compat: F.transform(
        S.update_tokens(sql), lambda t: S.rewritten_token(t, F.lit(None).cast("string"), compat)
    )
    row = update.select(
        S.rebuilt_update(sql, S.update_columns(sql), same(False)).alias("a"),
        S.rebuilt_update(sql, S.update_columns(sql), same(True)).alias("b"),
    ).first()
    assert row.a == "UPDATE dbo.T SET A = 'it''s', B = 2 WHERE Id=1"
    assert row.b == "UPDATE dbo.T SET A = 'it''''s', B = 2 WHERE Id=1"
    rows_sql = spark.createDataFrame([("insert into t (a,b) VALUES ('x',1), ('y',2) -- end",)], "sql_text STRING")
    kept = F.transform(
        S.multirow_tokens(sql), lambda r: F.transform(r, lambda t: S.rewritten_token(t, F.lit(None).cast("string")))
    )
    assert rows_sql.select(S.rebuilt_rows(sql, kept)).first()[0] == "insert into t (a,b) VALUES ('x', 1), ('y', 2)"
