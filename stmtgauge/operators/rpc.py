"""Decisions and fixed-width corrections on parameters of remote procedure calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtgauge.functions.binary import utf16_lenient
from stmtgauge.functions.text import utf16_units
from stmtgauge.operators.correct import as_log
from stmtgauge.operators.normalize import suggest_normalizations
from stmtgauge.operators.once import once
from stmtgauge.operators.policy import RuleSet, decision_of
from stmtgauge.operators.small import broadcast_if_small

# Fixed values.
VALUE_CHARS = 80
DEFAULT_PROC = "sp_executesql"
DEFAULT_TYPE = "nvarchar"
KNOWN_TYPES = ("nvarchar", "int", "bit")


def param_decisions(params: DataFrame, rules: DataFrame, env: str | None = None, form: str = "auto") -> DataFrame:
    """Log rows (step 2), one per parameter; ``params`` as from ``shred.rpc_params``. Only column rules can match."""
    found = RuleSet.prepare(rules, env, form).match_column(params, F.col("name"), "__by_column")
    passed = [c for c in ("ts", "spid") if c in params.columns]
    return as_log(
        found.withColumn("d", decision_of("__by_column")).select(
            "seq", *passed, F.lit(2).alias("step"), F.lit(0).alias("row"), "pos", "d.action", "d.rule_id", "d.reason",
            F.col("name").alias("param"), F.left("value", F.lit(VALUE_CHARS)).alias("value"),
        )
    )


def call_outcomes(decisions: DataFrame, mode: str = "log") -> DataFrame:
    """(seq, has_block, blocked): a call is dropped in enforce mode when any parameter is blocked."""
    calls = decisions.where(F.col("step") == 2).groupBy("seq").agg(F.max(F.col("action") == "block").alias("has_block"))
    return calls.withColumn("blocked", F.col("has_block") & F.lit(mode == "enforce"))


def fixed_width_corrections(
    calls: DataFrame,
    params: DataFrame,
    rules: DataFrame,
    env: str | None = None,
    truncate: bool = False,
    text_col: str = "sql_text",
    form: str = "auto",
) -> DataFrame:
    """Corrections that keep the length of the call: (seq, pos, name, before, after, written, truncated, rule_id, reason,
    corrected_text), for calls without a blocked parameter.

    A correction must fit the UTF-16 length of the old value (shorter ones get spaces), longer ones are skipped or cut.
    Each replaces the first place of its old value in the text left by the corrections before it. One call has few
    parameters, so they are gathered per call.
    """
    found = RuleSet.prepare(rules, env, form).match_column(params, F.col("name"), "__by_column")
    found = found.withColumn("d", decision_of("__by_column")).select(
        "seq", "pos", "name", "value", "d.action", "d.rule_id", "d.reason"
    )
    action = F.col("action")
    fixed = suggest_normalizations(found.withColumn("before", F.when(action == "autocorrect", F.col("value"))), "before", "s")
    after, before = F.col("s.normalized"), F.col("before")
    room, need = utf16_units(before), utf16_units(after)
    cut = utf16_lenient(F.substring(F.encode(after, "UTF-16LE"), F.lit(1), room * 2))
    fits = need <= room
    written = F.when(fits, F.concat(after, F.repeat(F.lit(" "), room - need))).when(F.lit(truncate), cut)
    change = F.struct(
        "pos", "name", F.col("before"), after.alias("after"), F.col("written"), (~fits).alias("truncated"),
        "rule_id", "reason",
    )
    fixed = once(fixed, {"written": written})
    per_call = (
        fixed.select("seq", (action == "block").alias("block"), F.when(F.col("written").isNotNull(), change).alias("change"))
        .groupBy(F.col("seq").alias("__seq"))
        .agg(F.max("block").alias("__block"), F.sort_array(F.collect_list("change")).alias("__changes"))
        .where(~F.col("__block") & (F.size("__changes") > 0))
    )
    item = (
        "struct<pos:int,name:string,before:string,after:string,written:string,truncated:boolean,rule_id:string,"
        "reason:string>"
    )
    start = F.struct(F.col(text_col).alias("text"), F.array().cast(f"array<{item}>").alias("done"))

    def step(state, change):
        at = F.position(change["before"], state["text"])
        text = F.concat(
            F.left(state["text"], at - 1),
            change["written"],
            F.substr(state["text"], at + F.length(change["before"])),
        )
        return F.when(
            at > 0, F.struct(text.alias("text"), F.concat(state["done"], F.array(change)).alias("done"))
        ).otherwise(state)

    folded = calls.select("seq", text_col).join(per_call, F.col("seq") == F.col("__seq"))
    folded = folded.withColumn("__result", F.aggregate(F.col("__changes").cast(f"array<{item}>"), start, step))
    return folded.select("seq", F.col("__result.text").alias("corrected_text"), F.explode("__result.done").alias("c")).select(
        "seq", "c.*", "corrected_text"
    )


def inplace_log(corrections: DataFrame) -> DataFrame:
    """Log rows (step 3) of :func:`fixed_width_corrections`."""
    return as_log(
        corrections.select(
            "seq", F.lit(3).alias("step"), F.lit(0).alias("row"), "pos",
            F.lit("rpc_autocorrect_inplace").alias("action"), "rule_id", "reason", F.col("name").alias("param"),
            "before", "after",
        )
    )


def param_types(params: DataFrame, types: DataFrame) -> DataFrame:
    """Add ``type`` to parameters: the declared one by procedure and name, else the text type."""
    first = types.groupBy(F.lower("proc").alias("__proc"), F.lower(F.ltrim("param", F.lit("@"))).alias("__param")).agg(
        F.max("type").alias("__declared")
    )
    named = params.withColumn("proc", F.coalesce("proc", F.lit(DEFAULT_PROC)))
    joined = named.join(
        broadcast_if_small(first),
        (F.lower(named["proc"]) == F.col("__proc")) & (F.lower(F.ltrim(named["name"], F.lit("@"))) == F.col("__param")),
        "left",
    )
    declared = F.lower(F.col("__declared"))
    return joined.withColumn("type", F.when(declared.isin(*KNOWN_TYPES), declared).otherwise(F.lit(DEFAULT_TYPE))).drop(
        "__proc", "__param", "__declared"
    )
