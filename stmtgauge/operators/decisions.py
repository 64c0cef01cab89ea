"""Summaries of a decision log and of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtgauge.functions.text import nonempty
from stmtgauge.sources.storage import materialize

NO_RULE = "(no_rule)"
# Actions listed for every rule in the insight context; length of a reason in the recent view.
CONTEXT_ACTIONS = ("block", "autocorrect", "rpc_autocorrect_inplace")
REASON_CHARS = 120


def rule_name(c: str = "rule_id") -> Column:
    return F.coalesce(nonempty(F.col(c)), F.lit(NO_RULE))


def action_name() -> Column:
    return F.lower(F.coalesce("action", F.lit("")))


def first_sample() -> Column:
    return F.coalesce(nonempty(F.col("sample")), nonempty(F.col("before")), F.lit(""))


def totals_by_action(decisions: DataFrame) -> DataFrame:
    """(action, n), most frequent first."""
    counts = decisions.groupBy(action_name().alias("action")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "action")


def counts_by_rule(decisions: DataFrame) -> DataFrame:
    """(rule, action, n)."""
    return decisions.groupBy(rule_name().alias("rule"), action_name().alias("action")).agg(F.count("*").alias("n"))


def samples_by_rule(decisions: DataFrame, sample: Column, order: tuple[str, ...], n: int = 3) -> DataFrame:
    """(rule, rank, sample): the first samples of each rule. Tasks keep ``n`` rows per rule before the shuffle."""
    arrival = Window.partitionBy("rule").orderBy(*order)
    ranked = decisions.select(rule_name().alias("rule"), sample.alias("sample"), *order).withColumn(
        "rank", F.row_number().over(arrival)
    )
    return ranked.where(F.col("rank") <= n).select("rule", "rank", "sample")


def tail(decisions: DataFrame, n: int, order: tuple[str, ...]) -> DataFrame:
    """The last ``n`` rows in arrival order."""
    return decisions.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def of_day(decisions: DataFrame, day: str) -> DataFrame:
    return decisions.where(F.col("ts_date") == F.lit(day).cast("date"))


def day_dashboard(
    decisions: DataFrame,
    day: str,
    rule: str | None = None,
    action: str | None = None,
    last_n: int | None = None,
    order: tuple[str, ...] = ("seq",),
) -> DataFrame:
    """(rule, action, n) of one day. ``last_n`` first keeps the last rows of the whole log, as a bounded dashboard
    does; without it the whole day counts."""
    rows = tail(decisions, last_n, order) if last_n else decisions
    counts = counts_by_rule(of_day(rows, day))
    if rule:
        counts = counts.where(F.col("rule") == rule)
    if action:
        counts = counts.where(F.col("action") == action)
    return counts


def as_maps(counts: DataFrame) -> DataFrame:
    """(rule, actions): counts of a rule as a map."""
    return counts.groupBy("rule").agg(F.map_from_entries(F.collect_list(F.struct("action", "n"))).alias("actions"))


def rule_context(decisions: DataFrame) -> DataFrame:
    """One row per rule with the counts of the three acting verdicts; other verdicts only list the rule."""
    return decisions.groupBy(rule_name().alias("rule")).agg(
        *[F.count_if(action_name() == a).alias(a) for a in CONTEXT_ACTIONS]
    )


def recent_decisions(decisions: DataFrame, n: int, order: tuple[str, ...]) -> DataFrame:
    """Last ``n`` decisions with shortened reason."""
    return tail(decisions, n, order).select(
        *order, "ts", "action", "rule_id", F.left(F.coalesce("reason", F.lit("")), F.lit(REASON_CHARS)).alias("reason")
    )


# -- counters ------------------------------------------------------------------------------------------------------
def counter_increments(log: DataFrame) -> DataFrame:
    """(key, by): the counters each log row adds to.

    Statement decisions, corrected cells and corrected parameters count for their rule; corrections also have a counter
    of their own. Verdicts on call parameters count nothing.
    """
    per_rule = F.when(
        nonempty(F.col("rule_id")).isNotNull() & (F.col("step") != 2), F.concat_ws(":", F.lit("rule"), "rule_id", "action")
    )
    own = F.when(F.col("step") == 1, F.lit("autocorrect_suggested")).when(
        F.col("step") == 3, F.lit("rpc_autocorrect_inplace")
    )
    return log.select(F.explode(F.array_compact(F.array(per_rule, own))).alias("key"), F.lit(1).cast("bigint").alias("by"))


def gate_increments(gates: DataFrame) -> DataFrame:
    """(key, by) of block decisions on statements (see ``correct.apply_thresholds``): enforced ones count as ``blocks``,
    others as ``gated_by_threshold``."""
    key = F.when(F.col("enforced"), F.lit("blocks")).otherwise(F.lit("gated_by_threshold"))
    return gates.select(key.alias("key"), F.lit(1).cast("bigint").alias("by"))


def call_increments(calls: DataFrame, log: DataFrame, mode: str = "log") -> DataFrame:
    """(key, by) of calls (``seq``): each is ``rpc_seen``; in ``enforce`` mode one with a blocked parameter in the log
    (step 2) is ``rpc_blocked``."""
    one = F.lit(1).cast("bigint").alias("by")
    seen = calls.select(F.lit("rpc_seen").alias("key"), one)
    if mode != "enforce":
        return seen
    blocked = log.where((F.col("step") == 2) & (F.col("action") == "block")).select("seq").distinct()
    return seen.unionByName(blocked.select(F.lit("rpc_blocked").alias("key"), one))


def size_increments(flagged: DataFrame) -> DataFrame:
    """(key, by): texts whose rewrite was too large (see ``correct.oversized_rewrites``)."""
    one = F.lit(1).cast("bigint").alias("by")
    return flagged.where("rewrite_skipped_size").select(F.lit("rewrite_skipped_size").alias("key"), one)


def counters(increments: DataFrame) -> DataFrame:
    """(key, rule, action, n): summed counters; ``rule:<id>:<action>`` keys are taken apart."""
    totals = increments.groupBy("key").agg(F.sum("by").alias("n"))
    parts = F.split("key", ":", 3)
    of_rule = F.col("key").startswith("rule:") & (F.size(parts) == 3)
    return totals.select(
        "key",
        F.when(of_rule, F.get(parts, F.lit(1))).alias("rule"),
        F.when(of_rule, F.get(parts, F.lit(2))).alias("action"),
        "n",
    )


def rule_counters(counter_table: DataFrame, rule_id: str) -> DataFrame:
    """(action, n) of one rule, by key prefix."""
    prefix = f"rule:{rule_id}:"
    return counter_table.where(F.col("key").startswith(prefix)).select(
        F.substr("key", F.lit(len(prefix) + 1)).alias("action"), "n"
    )


def counter_panel(counter_table: DataFrame, keys: tuple[str, ...], actions: tuple[str, ...]) -> DataFrame:
    """One row with the sum of each named key and of each rule action."""
    key_sums = [F.coalesce(F.sum(F.when(F.col("key") == k, F.col("n"))), F.lit(0)).alias(k) for k in keys]
    action_sums = [
        F.coalesce(F.sum(F.when(F.col("action") == a, F.col("n"))), F.lit(0)).alias(f"rule_{a}") for a in actions
    ]
    return counter_table.agg(*key_sums, *action_sums)


# -- evaluation of rules over an event table -----------------------------------------------------------------------
def evaluate(decided: DataFrame, order: tuple[str, ...] = ("seq",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals by action, counts by rule and action, and three samples per rule of events with a ``decision``.

    The decisions are written once; totals come from the counts, and the samples from the same stored rows.
    """
    text = F.coalesce(nonempty(F.col("sql_text")), nonempty(F.col("value")), F.lit(""))
    flat = materialize(decided.select(*order, text.alias("sample"), "decision.action", "decision.rule_id"), "decided")
    sample = F.col("sample")
    counts = counts_by_rule(flat)
    totals = counts.groupBy("action").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "action")
    return totals, counts, samples_by_rule(flat, sample, order)
