"""Derived views over the driver tables. The driver tables hold no SQL text, so statements, values, rules and packets are
built from their rows, with expressions that Spark and the checking database both understand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.operators import correct, rpc, shred
from stmtgauge.operators.once import once
from stmtgauge.sources.rules import RULE_SCHEMA
from stmtgauge.sources.storage import read_table

# ~ stands for a single quote inside the templates.
_STATEMENTS = """
    CASE event_id % 10
    WHEN 0 THEN concat('INSERT INTO dbo.Customers (Name,Phone,Email) VALUES (~Customer ', u, '~, ~070 ', lpad(u, 7, '0'),
        '~, ~USER', u, '@EXAMPLE.COM~)')
    WHEN 1 THEN concat('INSERT INTO dbo.Items (Sku,Price) VALUES (~A', u, '~, ~', v, '~), (~B', u, '~, ~12,5~)')
    WHEN 2 THEN concat('UPDATE dbo.Customers SET Phone = ~0046(0)70', lpad(u, 7, '0'), '~, Email = ~~ WHERE Id=', u)
    WHEN 3 THEN 'SELECT * FROM dbo.Orders'
    WHEN 4 THEN concat('SELECT Id, Amount FROM [dbo].[Payments] WHERE Amount > ', u)
    WHEN 5 THEN 'MERGE INTO [dbo].[Target] AS t USING dbo.Source s ON t.Id = s.Id WHEN MATCHED THEN UPDATE SET t.Email = s.Email WHEN NOT MATCHED THEN INSERT (Id, Email) VALUES (s.Id, s.Email);'
    WHEN 6 THEN concat('BULK INSERT dbo.Customers FROM ~in/cust', u, '.csv~ WITH (FIELDTERMINATOR=~,~)')
    WHEN 7 THEN concat('INSERT INTO dbo.Orders (Country,OrderDate,Ref) VALUES (~sweden~, ~', d, '/', m, '/24~, ~it~~s, ',
        u, '~)')
    WHEN 8 THEN concat('dbo.UpdateCustomer @Phone=~070', lpad(u, 7, '0'), '~, @CustomerId=~', u, '~')
    ELSE CASE WHEN event_id % 20 = 9 THEN NULL ELSE '' END
    END
"""

QUERY_LOG = f"""
    SELECT event_id AS seq, ts, concat('u', u) AS user_name, event_type AS client_app, value AS duration,
        replace({_STATEMENTS}, '~', chr(39)) AS sql_text
    FROM (
        SELECT event_id, ts, event_type, value, CAST(user_id AS STRING) AS u,
            CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS v,
            CAST(event_id % 28 + 1 AS STRING) AS d, CAST(event_id % 12 + 1 AS STRING) AS m
        FROM {{events}}
    ) AS e
"""

_K = "CAST(c_custkey AS STRING)"


def _n(modulus: int, plus: int = 0) -> str:
    return f"CAST(c_custkey % {modulus} + {plus} AS STRING)"


# (family, expression over customer): one raw string of each family per customer.
DIRTY_FAMILIES = [
    ("date_dmy", f"concat({_n(31, 1)}, '/', {_n(12, 1)}, '/', {_n(80, 20)})"),
    ("date_dash", f"concat(' ', {_n(28, 1)}, '-', {_n(12, 1)}, '-20', {_n(80, 20)})"),
    ("date_iso", f"concat('2024-', lpad({_n(14, 1)}, 2, '0'), '-', lpad({_n(31, 1)}, 2, '0'))"),
    ("moment_loose", f"concat('2024-', {_n(12, 1)}, '-', {_n(31, 1)}, ' ', {_n(24)}, ':', lpad({_n(60)}, 2, '0'))"),
    ("moment_dmy", f"concat({_n(31, 1)}, '/', {_n(12, 1)}, '/2023 ', {_n(24)}, ':', lpad({_n(60)}, 2, '0'), ':07')"),
    (
        "moment_iso",
        f"concat('2023-', lpad({_n(12, 1)}, 2, '0'), '-', lpad({_n(31, 1)}, 2, '0'), 'T', lpad({_n(26)}, 2, '0'), ':05:',"
        f" lpad({_n(60)}, 2, '0'), '.25')",
    ),
    ("phone", f"concat('070 ', lpad({_K}, 7, '0'))"),
    ("phone_prefix", f"concat('00', {_n(3, 45)}, ' (0)8-', {_K})"),
    ("phone_plus", f"concat('+46 ', {_K})"),
    ("postal", f"concat('1', {_n(90, 10)}, ' ', {_n(90, 10)})"),
    ("email", f"concat(' User.', {_K}, '@Example.COM ')"),
    ("email_bad", f"concat('user', {_K}, '@example')"),
    ("decimal_comma", f"concat({_n(9, 1)}, ' ', lpad({_n(1000)}, 3, '0'), ',', {_n(100)})"),
    ("decimal_sign", f"concat('-', lpad({_n(50)}, 4, '0'), '.', {_n(7)}, '0')"),
    ("decimal_point", f"concat('.', {_n(100)}, '_', {_n(10)})"),
    (
        "uuid",
        f"concat('{{{{', upper(substring(md5({_K}), 1, 8)), '-', substring(md5({_K}), 9, 4), '-', substring(md5({_K}), 13, 4),"
        f" '-', substring(md5({_K}), 17, 4), '-', substring(md5({_K}), 21, 12), '}}}}')",
    ),
    (
        "country",
        "CASE c_custkey % 8 WHEN 0 THEN 'sweden' WHEN 1 THEN 'USA' WHEN 2 THEN ' se ' WHEN 3 THEN 'uk' WHEN 4 THEN"
        " 'Deutschland' WHEN 5 THEN 'Atlantis' WHEN 6 THEN 'Suomi' ELSE 'united kingdom' END",
    ),
    ("orgnr", f"concat('16', lpad({_K}, 6, '5'), '-', lpad({_n(9999)}, 4, '0'))"),
    ("orgnr_plain", f"concat('55', lpad({_K}, 4, '6'), '-', lpad({_n(9999)}, 4, '0'))"),
    ("text", f"concat('note ', {_K})"),
    ("gap", "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE '' END"),
]

# Tokens that look like mail addresses, numbers or phone numbers; ASCII and without look-around.
TOKEN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+|\+?[0-9][0-9 ,.()/:-]*[0-9]"

# Rules in force: every target, a disabled one, one bound to environments, one with a threshold.
RULES = [
    # ord, id, target, selector, action, reason, confidence, enabled, apply_in_envs, min_hits_to_enforce
    (0, "customer-phone", "column", "dbo.Customers.Phone", "autocorrect", "Phone numbers in one format", 0.95, True, None, 0),
    (1, "any-email", "column", "Email", "autocorrect", "Lower-case addresses", 0.9, True, None, 0),
    (2, "param-customer", "column", "@CustomerId", "block", "Id must be checked", 0.8, True, None, 0),
    (3, "orders-insert", "pattern", "INSERT INTO dbo.Orders", "block", "No direct inserts", 0.9, True, None, 10),
    (4, "no-selects", "pattern", "select", "block", "Switched off", 0.5, False, None, 0),
    (5, "country-code", "column", "country", "autocorrect", "Two-letter codes", 0.9, True, ["Dev", "staging"], 10),
    (6, "items-table", "table", "DBO.ITEMS", "autocorrect", "Prices with a point", 0.7, True, None, 0),
    (7, "payments-read", "pattern", "[Payments]", "block", "Payments are private", 1.0, True, [], 0),
]
CHANGED_RULES = [r for r in RULES if r[0] != 4] + [
    (8, "phone-param", "column", "@phone", "autocorrect", "Phone numbers in one format", 0.9, True, None, 0)
]

PARAM_TYPES = [
    ("dbo.updatecustomer", "customerid", "INT"),
    ("dbo.updatecustomer", "phone", "nvarchar"),
    ("dbo.createorder", "orderref", "money"),
]


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, f"{sf_dir}/{name}.parquet") for name in names}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark.sql(QUERY_LOG, **tables(spark, sf_dir, "events")))


def finished(log: DataFrame) -> DataFrame:
    """Statements as a stored log would hold them: their text is built once, not again in every step that reads it."""
    return once(log, {"sql_text": F.col("sql_text")})


def rules(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rows is None else rows, RULE_SCHEMA)


def rules_many(spark: SparkSession, n: int) -> DataFrame:
    """The rules in force behind ``n`` generated column rules that never match."""
    generated = spark.range(n).selectExpr(
        "CAST(id AS INT) AS ord", "concat('generated-', id) AS id", "'column' AS target", "concat('Unused', id) AS selector",
        "'block' AS action", "'generated' AS reason", "CAST(1.0 AS DOUBLE) AS confidence", "true AS enabled",
        "CAST(NULL AS ARRAY<STRING>) AS apply_in_envs", "0 AS min_hits_to_enforce",
    )
    return generated.unionByName(rules(spark).withColumn("ord", F.col("ord") + n))


def patterns_many(spark: SparkSession, n: int) -> DataFrame:
    """The rules in force behind ``n`` generated pattern rules that never match."""
    generated = rules_many(spark, n).where(F.col("id").startswith("generated-"))
    generated = generated.withColumn("target", F.lit("pattern")).withColumn(
        "selector", F.concat(F.lit("UPDATE dbo.Unused"), "ord")
    )
    return generated.unionByName(rules(spark).withColumn("ord", F.col("ord") + n))


def dirty_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ", ".join(f"struct('{family}' AS family, {expr} AS value)" for family, expr in DIRTY_FAMILIES)
    sql = f"SELECT k, f.family, f.value FROM (SELECT c_custkey AS k, explode(array({items})) AS f FROM {{customer}})"
    return once(spark.sql(sql, **tables(spark, sf_dir, "customer")), {"value": F.col("value")})


def doc_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    return docs.select("doc_id", "lang", "source", F.explode(tokens).alias("value"))


def policy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the statements as events: (seq, cell, sql_text, table, column, value)."""
    cells = shred.profiled_values(query_log(spark, sf_dir), keep=("seq", "sql_text"))
    return cells.select("seq", "sql_text", "table", F.concat_ws(".", "table", "column").alias("column"), "value")


def param_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARAM_TYPES, "proc STRING, param STRING, type STRING")


def rpc_calls(log: DataFrame) -> DataFrame:
    return log.where(F.contains("sql_text", F.lit("@")) & F.col("sql_text").startswith("dbo."))


def decisions_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement, cell and parameter decisions of all statements, with ``ts_date``."""
    log, in_force = query_log(spark, sf_dir), rules(spark)
    params = shred.rpc_params(rpc_calls(log), keep=("seq", "ts"))
    parts = (
        correct.statement_decisions(log, in_force)
        .unionByName(correct.cell_corrections(log, in_force))
        .unionByName(rpc.param_decisions(params, in_force))
    )
    return parts.withColumn("ts_date", F.to_date("ts"))


RULE_TABLE = """
    SELECT p_partkey AS ord,
        CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE concat('rule-', CAST(p_partkey % 1900 AS STRING)) END AS id,
        CASE p_size % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'column' WHEN 2 THEN 'Pattern' WHEN 3 THEN 'row' WHEN 4 THEN 'COLUMN'
            ELSE NULL END AS target,
        CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '' ELSE p_name END AS selector,
        CASE p_partkey % 5 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' WHEN 2 THEN 'autocorrect' WHEN 3 THEN 'Block'
            ELSE 'warn' END AS action,
        p_type AS reason,
        p_retailprice / 1000 AS confidence,
        p_partkey % 3 <> 0 AS enabled,
        CAST(p_size AS BIGINT) AS min_hits
    FROM {part}
"""

# The same rules as JSON texts per field, with more defects.
RAW_RULES = """
    SELECT p_partkey AS ord,
        CASE p_partkey % 23 WHEN 0 THEN NULL WHEN 1 THEN '""' WHEN 2 THEN '7'
            ELSE concat('"rule-', CAST(p_partkey % 1500 AS STRING), '"') END AS id,
        CASE p_size % 7 WHEN 0 THEN '"row"' WHEN 1 THEN '"table"' WHEN 2 THEN '"pattern"' ELSE '"column"' END AS target,
        CASE WHEN p_partkey % 29 = 0 THEN '""' ELSE concat('"', p_name, '"') END AS selector,
        CASE p_partkey % 9 WHEN 0 THEN '"warn"' WHEN 1 THEN '"allow"' WHEN 2 THEN '"block"' ELSE '"autocorrect"' END AS action,
        CASE p_partkey % 31 WHEN 0 THEN '12' WHEN 1 THEN 'null' ELSE concat('"', p_type, '"') END AS reason,
        CASE p_partkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '"0.5"' WHEN 2 THEN '1.5' WHEN 3 THEN '-0.1' ELSE '0.75' END
            AS confidence,
        CASE p_partkey % 37 WHEN 0 THEN '"yes"' WHEN 1 THEN '1' WHEN 2 THEN NULL ELSE 'true' END AS enabled,
        CASE p_partkey % 43 WHEN 0 THEN '"dev"' WHEN 1 THEN '[1]' WHEN 2 THEN '[]' WHEN 3 THEN '["dev","staging"]'
            ELSE NULL END AS apply_in_envs,
        CASE p_partkey % 47 WHEN 0 THEN '-1' WHEN 1 THEN '2.5' WHEN 2 THEN 'null' WHEN 3 THEN NULL
            ELSE CAST(p_size AS STRING) END AS min_hits_to_enforce
    FROM {part}
"""

# Two versions of the rules, keyed by part: every 10th is gone, every 7th changed, a shifted copy of every 11th is new.
RULES_BEFORE = """
    SELECT p_partkey AS id, p_name AS selector, p_type AS action, CAST(p_size AS BIGINT) AS min_hits FROM {part}
"""
RULES_AFTER = """
    SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN concat(p_name, '!') ELSE p_name END AS selector, p_type AS action,
        CASE WHEN p_partkey % 77 = 1 THEN NULL ELSE CAST(p_size AS BIGINT) END AS min_hits
    FROM {part} WHERE p_partkey % 10 <> 3
    UNION ALL
    SELECT p_partkey + 100000000, p_name, p_type, CAST(p_size AS BIGINT) FROM {part} WHERE p_partkey % 11 = 0
"""

REQUESTS = """
    SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0 THEN concat('Normalize all phone numbers: ', text)
        WHEN (conv_id + turn) % 7 = 0 THEN concat('Email must be set: ', text) ELSE text END AS text
    FROM {conversations} WHERE role = 'user'
"""


def sql_view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **tables(spark, sf_dir, *names))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(query_log(spark, sf_dir))


def packets_of(log: DataFrame) -> DataFrame:
    """Two packets per statement on two interleaved connections; only the second ends the message."""
    texts = log.where(F.coalesce("sql_text", F.lit("")) != "")
    data = F.encode("sql_text", "UTF-16LE")
    half = (F.length("sql_text") / 2).cast("int") * 2
    number = lambda c, width: F.unhex(F.lpad(F.hex(c), width * 2, "0"))

    def packet(part: int, payload):
        header = F.concat(
            F.when(F.col("sql_text").startswith("dbo."), F.unhex(F.lit("03"))).otherwise(F.unhex(F.lit("01"))),
            F.unhex(F.lit(f"0{part}")),
            number(F.octet_length(payload) + 8, 2),
            number(F.col("seq") % 1000, 2),
            F.unhex(F.lit(f"0{part + 1}00")),
        )
        return F.struct((F.col("seq") * 2 + part).alias("seq"), F.concat(header, payload).alias("bytes"))

    both = F.array(packet(0, F.substring(data, F.lit(1), half)), packet(1, F.substring(data, half + 1, F.octet_length(data))))
    return texts.select((F.col("seq") % 2).alias("conn_id"), F.explode(both).alias("p")).select("conn_id", "p.*")
