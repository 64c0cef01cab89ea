"""Statement shredding: a table of statements to relational facts.

Every function takes a DataFrame with a ``sql_text`` column and keeps the columns named in ``keep`` on its rows.
One statement gives few facts, so all of it is projection and ``posexplode``: no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtgauge.functions import statements as S
from stmtgauge.functions.text import plain_name, split_commas_outside_quotes, strip, unquote
from stmtgauge.operators.once import once

KEEP = ("seq",)


def _stripped(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, strip(F.col("sql_text")).alias("__sql"))


def written_columns(df: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """(table, pos, column) of each INSERT, else of each UPDATE."""
    sql = F.col("__sql")
    found = once(_stripped(df, keep), {"table": S.written_table(sql), "__c": S.written_columns(sql)})
    return found.select(*keep, "table", F.posexplode("__c").alias("pos", "column"))


def profiled_columns(df: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """(table, column) of each INSERT and of each UPDATE, both counted."""
    sql = F.col("__sql")
    pairs = lambda table, columns: F.coalesce(
        F.transform(columns, lambda c: F.struct(table.alias("table"), c.alias("column"))),
        F.array().cast("array<struct<table:string,column:string>>"),
    )
    both = F.concat(
        pairs(S.insert_table(sql), S.insert_columns(sql)), pairs(S.update_table(sql), S.update_columns(sql))
    )
    return _stripped(df, keep).select(*keep, F.explode(both).alias("__p")).select(*keep, "__p.*")


def profiled_values(df: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """(table, column, value, is_null) by the plain comma split; the table is the first one the statement writes."""
    sql = F.col("__sql")
    found = _stripped(df, keep).select(*keep, S.written_table(sql).alias("table"), F.explode(S.plain_pairs(sql)).alias("__p"))
    token = F.col("__p.token")
    return found.select(
        *keep, "table", "__p.column", unquote(token).alias("value"), S.token_is_null(token).alias("is_null")
    )


def written_values(df: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """(pos, value) of each INSERT, else of each UPDATE, quote-aware."""
    tokens = _stripped(df, keep).select(*keep, F.posexplode(S.written_tokens(F.col("__sql"))).alias("pos", "__t"))
    return tokens.select(*keep, "pos", unquote(F.col("__t")).alias("value"))


def multirow_values(df: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """(row, pos, value) of INSERT ... VALUES (..),(..)."""
    rows = df.select(*keep, F.posexplode(S.multirow_tokens(F.col("sql_text"))).alias("row", "__r"))
    return rows.select(*keep, "row", F.posexplode("__r").alias("pos", "__t")).select(
        *keep, "row", "pos", unquote(F.col("__t")).alias("value")
    )


def split_text(df: DataFrame, text_col: str, keep: Sequence[str] = KEEP) -> DataFrame:
    """(pos, piece) of a comma list in which quotes protect commas."""
    return df.select(*keep, F.posexplode(split_commas_outside_quotes(F.col(text_col))).alias("pos", "piece"))


def bulk_loads(df: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """(table, path) of BULK INSERT statements."""
    sql = F.col("__sql")
    return _stripped(df, keep).where(sql.rlike(S.BULK_LOAD)).select(
        *keep,
        F.regexp_extract(sql, S.BULK_LOAD, 1).alias("table"),
        F.regexp_extract(sql, S.BULK_LOAD, 2).alias("path"),
    )


def merges(df: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """(target, updated columns, inserted columns) of MERGE statements."""
    sql = F.col("__sql")
    facts = {
        "target": plain_name(F.regexp_extract(sql, S.MERGE_TARGET, 1)),
        "updated": S.merge_updated(sql),
        "inserted": S.merge_inserted(sql),
    }
    return once(_stripped(df, keep).where(sql.rlike(S.MERGE_TARGET)), facts).drop("__sql")


def selects(df: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """(table, expressions, star) of SELECT statements with a table."""
    sql = F.col("__sql")
    found = once(
        _stripped(df, keep).where(S.is_select(sql)), {"table": S.select_table(sql), "__list": S.select_list(sql)}
    )
    facts = {"expressions": S.select_expressions(F.col("__list")), "star": F.col("__list") == "*"}
    return once(found.where(F.col("table").isNotNull()), facts).drop("__sql", "__list")


def rpc_params(df: DataFrame, text_col: str = "sql_text", keep: Sequence[str] = KEEP) -> DataFrame:
    """(proc, pos, name, value) of the named parameters in the text of a remote procedure call."""
    text = F.col(text_col)
    calls = df.where(F.contains(text, F.lit("@"))).select(
        *keep, S.rpc_procedure(text).alias("proc"), F.posexplode(S.rpc_params(text)).alias("pos", "__p")
    )
    return calls.select(*keep, "proc", "pos", "__p.name", "__p.value")


def with_keyword(df: DataFrame) -> DataFrame:
    """Only rows whose text may hold a statement."""
    return df.where(S.has_keyword(F.col("sql_text")))
