"""Field profiles, SELECT usage, drift and their rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtgauge.functions import statements as S
from stmtgauge.functions.text import strip, unquote
from stmtgauge.operators import shred
from stmtgauge.operators.normalize import suggest_kind
from stmtgauge.operators.once import once


def write_counts(events: DataFrame) -> DataFrame:
    """(field, n): how often each ``table.column`` is written."""
    field = F.concat_ws(".", "table", "column")
    return shred.profiled_columns(events, keep=()).groupBy(field.alias("field")).agg(F.count("*").alias("n"))


def suggestion_counts(events: DataFrame) -> DataFrame:
    """(field, kind, n): how often each normalization is suggested for a field."""
    values = suggest_kind(shred.profiled_values(events, keep=()), "value").where(F.col("kind").isNotNull())
    return values.groupBy(F.concat_ws(".", "table", "column").alias("field"), "kind").agg(F.count("*").alias("n"))


def field_facts(events: DataFrame) -> DataFrame:
    """(field, written, value, is_null): one row per written column, one per written value, in a single pass."""
    sql = F.col("__sql")
    fact = lambda field, written, value, null: F.struct(
        field.alias("field"), written.alias("written"), value.alias("value"), null.alias("is_null")
    )
    none = F.array().cast("array<struct<field:string,written:int,value:string,is_null:boolean>>")
    name = lambda table, column: F.concat_ws(".", table, column)
    writes = lambda table, columns: F.coalesce(
        F.transform(columns, lambda c: fact(name(table, c), F.lit(1), F.lit(None).cast("string"), F.lit(False))), none
    )
    values = F.transform(
        S.plain_pairs(sql),
        lambda p: fact(
            name(F.col("__first"), p["column"]), F.lit(0), unquote(p["token"]), S.token_is_null(p["token"])
        ),
    )
    shredded = (
        events.select(strip(F.col("sql_text")).alias("__sql"))
        .where(F.lower("__sql").rlike("insert|update"))
    )
    shredded = once(shredded, {"__i": S.insert_table(sql), "__u": S.update_table(sql)})
    shredded = shredded.withColumn("__first", F.coalesce("__i", "__u")).where(F.col("__first").isNotNull())
    facts = F.concat(
        writes(F.col("__i"), S.insert_columns(sql)), writes(F.col("__u"), S.update_columns(sql)), values
    )
    return shredded.select(F.inline(facts))


def field_profiles(events: DataFrame, count_nulls: bool = True) -> DataFrame:
    """(field, count, nulls, suggestions): counts per ``table.column`` with suggestions by kind.

    One scan and one shuffle of partial counts; a field has at most nine kinds, so the second step is small.
    ``count_nulls`` counts bare NULLs and empty literals, otherwise nulls are 0.
    """
    facts = suggest_kind(field_facts(events), "value")
    null = F.col("is_null") & F.lit(count_nulls)
    facts = facts.where((F.col("written") == 1) | F.col("kind").isNotNull() | null)
    per_kind = facts.groupBy("field", "kind").agg(
        F.sum("written").alias("count"), F.count_if(null).alias("nulls"), F.count("kind").alias("n")
    )
    return per_kind.groupBy("field").agg(
        F.sum("count").alias("count"),
        F.sum("nulls").alias("nulls"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n"))))
        ).alias("suggestions"),
    )


def merge_profiles(previous: DataFrame, batch: DataFrame) -> DataFrame:
    """Profiles of two disjoint sets of events as one."""
    both = previous.unionByName(batch)
    flat = both.select("field", F.explode(F.map_entries("suggestions")).alias("e"))
    per_kind = flat.groupBy("field", F.col("e.key").alias("kind")).agg(F.sum("e.value").alias("n"))
    sums = both.select("field", "count", "nulls", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("n"))
    kinds = per_kind.select("field", F.lit(0).alias("count"), F.lit(0).alias("nulls"), "kind", "n")
    return sums.unionByName(kinds).groupBy("field").agg(
        F.sum("count").alias("count"),
        F.sum("nulls").alias("nulls"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n"))))
        ).alias("suggestions"),
    )


def merge_usage(previous: DataFrame, batch: DataFrame) -> DataFrame:
    """SELECT usage of two disjoint sets of events as one."""
    both = previous.unionByName(batch)
    return both.groupBy("table", "expression").agg(F.sum("n").alias("n"), F.sum("star").alias("star"))


def total_suggestions(suggestions: Column) -> Column:
    return F.aggregate(F.map_values(suggestions), F.lit(0).cast("bigint"), lambda a, n: a + n)


def select_columns(events: DataFrame) -> DataFrame:
    """(table, expression, n): how often each expression is selected from a table."""
    found = shred.selects(events, keep=())
    return found.select("table", F.explode("expressions").alias("expression")).groupBy("table", "expression").agg(
        F.count("*").alias("n")
    )


def select_stars(events: DataFrame) -> DataFrame:
    """(table, star): how often ``*`` is selected from a table."""
    return shred.selects(events, keep=()).groupBy("table").agg(F.count_if("star").alias("star"))


def select_usage(events: DataFrame) -> DataFrame:
    """(table, expression, n, star): both counts in one pass; the row without expression carries the stars.

    Long form on purpose: a table may be read with any number of expressions, too many for one map in one task.
    """
    found = shred.selects(events, keep=()).select(
        "table",
        F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("expressions"))).alias("expression"),
        "star",
    )
    first = F.col("expression").isNull()
    return found.groupBy("table", "expression").agg(
        F.count_if(~first).alias("n"), F.count_if(first & F.col("star")).alias("star")
    )


# -- rankings ------------------------------------------------------------------------------------------------------
def top_nulls(profiles: DataFrame, n: int = 10) -> DataFrame:
    return profiles.select("field", "count", "nulls").orderBy(F.desc("nulls"), "field").limit(n)


def top_suggestions(profiles: DataFrame, n: int = 10) -> DataFrame:
    """(field, total, kinds): fields with most suggestions; kinds as ``kind:n`` text, kinds in alphabetic order."""
    entries = F.transform(
        F.array_sort(F.map_entries("suggestions")), lambda e: F.concat_ws(":", e["key"], e["value"])
    )
    return (
        profiles.select("field", total_suggestions(F.col("suggestions")).alias("total"), F.array_join(entries, ", ").alias("kinds"))
        .orderBy(F.desc("total"), "field")
        .limit(n)
    )


def top_select_columns(usage: DataFrame, n: int = 5) -> DataFrame:
    """(table, expression, n, rank): the most selected expressions of each table, of (table, expression, n) rows."""
    order = Window.partitionBy("table").orderBy(F.desc("n"), "expression")
    return (
        usage.where(F.col("expression").isNotNull())
        .select("table", "expression", "n", F.row_number().over(order).alias("rank"))
        .where(F.col("rank") <= n)
    )


def null_ratio(nulls: Column, count: Column) -> Column:
    return F.coalesce(nulls, F.lit(0)) / F.greatest(F.coalesce(count, F.lit(0)), F.lit(1))


def null_drift(previous: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(field, drift): fields of either snapshot whose null ratio moved by the threshold or more, largest first."""
    p, c = previous.alias("p"), current.alias("c")
    drift = F.abs(
        null_ratio(F.col("c.nulls"), F.col("c.count")) - null_ratio(F.col("p.nulls"), F.col("p.count"))
    )
    joined = p.join(c, F.col("p.field") == F.col("c.field"), "full_outer")
    return (
        joined.select(F.coalesce("p.field", "c.field").alias("field"), drift.alias("drift"))
        .where(F.col("drift") >= threshold)
        .orderBy(F.desc("drift"), "field")
    )


def field_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("field").union(b.select("field")).distinct()


def field_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("field").intersect(b.select("field"))


def field_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("field").join(b.select("field"), "field", "left_anti").distinct()
