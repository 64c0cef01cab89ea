"""Decisions on statements and cells, corrections, threshold gates and outcomes.

The decision log is the table everything else reads (``LOG_COLUMNS``). Its rows are ordered by ``seq`` (the statement or
call), ``step`` (0 statement, 1 cell, 2 call parameter, 3 call correction), ``row`` and ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtgauge.functions import statements as S
from stmtgauge.functions.text import nonempty, strip, unquote, utf16_units
from stmtgauge.operators.normalize import suggest_normalizations
from stmtgauge.operators.once import once
from stmtgauge.operators.policy import RuleSet, decision_of, rule_index
from stmtgauge.operators.running import running_total
from stmtgauge.operators.small import broadcast_if_small

LOG_TYPES = {
    "seq": "bigint", "step": "int", "row": "int", "pos": "int", "ts": "timestamp", "spid": "int", "action": "string",
    "rule_id": "string", "reason": "string", "confidence": "double", "sample": "string", "before": "string",
    "after": "string", "column": "string", "param": "string", "value": "string",
}
LOG_ORDER = ("seq", "step", "row", "pos")

# Sizes and the actions that count as hits of a rule.
SAMPLE_CHARS = 200
MAX_REWRITE_BYTES = 131072
PACKET_HEADER_BYTES = 8
HIT_ACTIONS = ("block", "autocorrect", "rpc_autocorrect_inplace")

#: Ranks up to which the engine cuts groups off before the shuffle.
_GROUP_LIMIT = 1000


def as_log(df: DataFrame) -> DataFrame:
    """Bring rows to the full set of log columns."""
    have = set(df.columns)
    return df.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in LOG_TYPES.items()]
    )


def _texts(events: DataFrame, ruleset: RuleSet) -> DataFrame:
    filled = events.where(nonempty(F.col("sql_text")).isNotNull())
    return ruleset.match_pattern(filled, F.col("sql_text"), "__by_pattern")


def statement_decisions(events: DataFrame, rules: DataFrame, env: str | None = None, form: str = "auto") -> DataFrame:
    """Log rows (step 0), one per statement with text; only pattern rules can match here."""
    found = _texts(events, RuleSet.prepare(rules, env, form))
    passed = [c for c in ("ts", "spid") if c in events.columns]
    return as_log(
        found.withColumn("d", decision_of("__by_pattern")).select(
            "seq", *passed, F.lit(0).alias("step"), F.lit(0).alias("row"), F.lit(0).alias("pos"),
            "d.action", "d.reason", "d.confidence", "d.rule_id",
            F.left("sql_text", F.lit(SAMPLE_CHARS)).alias("sample"),
        )
    )


def _with_cells(statements: DataFrame) -> DataFrame:
    """Add ``__cells``, rows of tokens to check, and ``__many``: all VALUES rows when each has one token per column, else
    the single list if it fits, else NULL."""
    raw, n = F.col("sql_text"), F.size("__columns")
    lists = once(statements, {"__listed": S.multirow_tokens(raw), "__single": S.written_tokens(strip(raw))})
    many = (n > 0) & F.coalesce(F.forall("__listed", lambda r: F.size(r) == n), F.lit(False))
    one = (n > 0) & (F.size("__single") == n)
    cells = F.when(many, F.col("__listed")).when(one, F.array("__single"))
    return once(lists, {"__many": many, "__cells": cells}).drop("__listed", "__single")


def _decided_cells(events: DataFrame, rules: DataFrame, env: str | None, mode: str, form: str) -> DataFrame:
    """Every written cell with the decision ``d`` on it."""
    ruleset = RuleSet.prepare(rules, env, form)
    found = _texts(events, ruleset)
    if mode == "enforce":
        found = found.where(F.coalesce(F.col("__by_pattern.action") != "block", F.lit(True)))
    passed = [c for c in ("ts", "spid") if c in events.columns]
    sql = strip(F.col("sql_text"))
    named = once(
        found.select("seq", *passed, "sql_text", "__by_pattern"),
        {"__table": S.written_table(sql), "__columns": S.written_columns(sql)},
    ).where(F.col("__table").isNotNull())
    shred = _with_cells(named)
    # The statement's own match is found before the cells are spread out, so its text is not repeated per cell.
    shred = ruleset.match_table(shred, F.col("__table"), "__by_table").drop("sql_text")
    rows = shred.select("*", F.posexplode("__cells").alias("row", "__row")).drop("__cells", "__many")
    cells = rows.select("*", F.posexplode("__row").alias("pos", "__token")).drop("__row")
    cells = cells.select(
        "seq", *passed, "row", "pos", "__by_pattern", "__by_table",
        F.concat_ws(".", F.col("__table"), F.get("__columns", F.col("pos"))).alias("column"),
        unquote(F.col("__token")).alias("before"),
    )
    cells = ruleset.match_column(cells, F.col("column"), "__by_column")
    decided = cells.withColumn("d", decision_of("__by_pattern", "__by_table", "__by_column"))
    return decided.withColumn("blocked", F.col("__by_pattern.action").eqNullSafe("block")).withColumn(
        "by_column", F.col("d.rule_id").eqNullSafe(F.col("__by_column.id"))
    )


def decided_cells(events: DataFrame, rules: DataFrame, env: str | None = None, form: str = "auto") -> DataFrame:
    """Written cells that a rule corrects or blocks, with the decision ``d`` on them.

    Write it once where several steps need it and hand it to them as ``decided``: shredding is the costly part.
    """
    cells = _decided_cells(events, rules, env, "log", form).where(F.col("d.action").isin("autocorrect", "block"))
    return cells.drop("__by_pattern", "__by_table", "__by_column")


def _cells_of(
    events: DataFrame, rules: DataFrame, env: str | None, mode: str, form: str, decided: DataFrame | None
) -> DataFrame:
    if decided is None:
        return _decided_cells(events, rules, env, mode, form)
    return decided.where("NOT blocked") if mode == "enforce" else decided


def ignored_blocks(
    events: DataFrame, rules: DataFrame, env: str | None = None, mode: str = "log", form: str = "auto",
    decided: DataFrame | None = None,
) -> DataFrame:
    """(seq, n): written cells whose first matching rule is a block by column. Such rules stop calls only; in statements
    they have no effect, which this shows."""
    cells = _cells_of(events, rules, env, mode, form, decided)
    return cells.where((F.col("d.action") == "block") & F.col("by_column")).groupBy("seq").agg(F.count("*").alias("n"))


def cell_corrections(
    events: DataFrame, rules: DataFrame, env: str | None = None, mode: str = "log", form: str = "auto",
    decided: DataFrame | None = None,
) -> DataFrame:
    """Log rows (step 1) for every written value that an autocorrect rule changes.

    The rules see table, ``table.column`` and text, so a table or pattern rule may decide first. In ``enforce`` mode
    statements with a block decision are left alone.
    """
    chosen = _cells_of(events, rules, env, mode, form, decided).where(F.col("d.action") == "autocorrect")
    passed = [c for c in ("ts", "spid") if c in events.columns]
    fixed = suggest_normalizations(chosen, "before", "s").where(F.col("s.normalized") != F.col("before"))
    return as_log(
        fixed.select(
            "seq", *passed, F.lit(1).alias("step"), "row", "pos", "d.action", "d.rule_id", "d.reason",
            "before", F.col("s.normalized").alias("after"), "column",
        )
    )


def corrected_statements(events: DataFrame, corrections: DataFrame, compat: bool = False) -> DataFrame:
    """(seq, sql_text, corrected) for statements with corrected cells.

    Corrections of one statement are few; they are gathered per statement and only changed statements are rewritten.
    """
    place = lambda row, pos: F.concat_ws(":", row, pos)
    per_statement = corrections.groupBy(F.col("seq").alias("__seq")).agg(
        F.map_from_entries(
            F.collect_list(F.struct(place(F.col("row"), F.col("pos")).alias("place"), F.col("after")))
        ).alias("__after")
    )
    changed = events.select("seq", "sql_text").join(per_statement, F.col("seq") == F.col("__seq"))
    sql = strip(F.col("sql_text"))
    changed = _with_cells(once(changed, {"__columns": S.written_columns(sql)}))
    after = lambda i, j: F.try_element_at(F.col("__after"), place(i, j))
    texts = F.transform(
        "__cells",
        lambda row, i: F.transform(row, lambda token, j: S.rewritten_token(token, after(i, j), compat)),
    )
    changed = once(changed, {"__texts": texts})
    raw, columns = F.col("sql_text"), F.col("__columns")
    single = F.get(F.col("__texts"), F.lit(0))
    corrected = F.when(F.col("__many"), S.rebuilt_rows(raw, F.col("__texts"))).otherwise(
        F.coalesce(S.rebuilt_insert(raw, single), S.rebuilt_update(raw, columns, single))
    )
    rebuilt = once(changed, {"corrected": corrected})
    return rebuilt.select("seq", "sql_text", "corrected").where(F.col("corrected").isNotNull())


def split_hits(log: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Block decisions on statements whose rule has no threshold, as gates; and all hits of rules that have one, in
    ``LOG_ORDER`` columns with ``rule_id``, ``min_hits`` and ``is_block`` (whether a gate is asked for)."""
    index = rule_index(rules).select(
        F.col("id").alias("rule_id"), F.coalesce("rule.min_hits_to_enforce", F.lit(0)).alias("min_hits")
    )
    hits = log.where(F.col("rule_id").isNotNull() & F.col("action").isin(*HIT_ACTIONS) & (F.col("step") != 2))
    hits = hits.select(*LOG_ORDER, "rule_id", "action").join(broadcast_if_small(index), "rule_id", "left")
    hits = hits.withColumn("min_hits", F.coalesce("min_hits", F.lit(0)))
    is_block = (F.col("step") == 0) & (F.col("action") == "block")
    # Only rules with a threshold need a count: the others enforce at once.
    free = hits.where(is_block & (F.col("min_hits") <= 0)).select(
        "seq", "rule_id", F.lit(None).cast("bigint").alias("hits"), F.col("min_hits").cast("bigint"),
        F.lit(True).alias("enforced"),
    )
    counted = hits.where(F.col("min_hits") > 0)
    return free, counted.select(*LOG_ORDER, "rule_id", "min_hits", is_block.alias("is_block"))


def _earlier_hits(start_counters: DataFrame) -> DataFrame:
    known = start_counters.where(F.col("action").isin(*HIT_ACTIONS))
    return broadcast_if_small(known.groupBy("rule_id").agg(F.sum("n").alias("__earlier")))


def apply_thresholds(log: DataFrame, rules: DataFrame, start_counters: DataFrame | None = None) -> DataFrame:
    """(seq, rule_id, hits, min_hits, enforced) for each block decision on a statement.

    A rule with ``min_hits_to_enforce`` blocks only from that hit on; the current hit counts. A rule that is not in the
    table has no threshold: it blocks at once. ``start_counters`` holds earlier hits as (rule_id, action, n).
    """
    free, hits = split_hits(log, rules)
    counted = running_total(hits, ["rule_id"], "seq", LOG_ORDER[1:], F.lit(1), "hits").where("is_block")
    if start_counters is not None:
        counted = counted.join(_earlier_hits(start_counters), "rule_id", "left").withColumn(
            "hits", F.col("hits") + F.coalesce("__earlier", F.lit(0))
        )
    gated = counted.select(
        "seq", "rule_id", F.col("hits").cast("bigint"), F.col("min_hits").cast("bigint"),
        (F.col("hits") >= F.col("min_hits")).alias("enforced"),
    )
    return free.unionByName(gated)


def enforcement_cutoffs(log: DataFrame, rules: DataFrame, start_counters: DataFrame | None = None) -> DataFrame:
    """(rule_id, cut): for each rule with a threshold that is reached the position (``LOG_ORDER``) of the hit that reaches
    it; a null ``cut`` when earlier hits alone do.

    A rule's first ``min_hits`` hits decide. Every task passes on the first so many of each rule alone, so a rule with a
    third of all hits sends few rows; only thresholds above ``_GROUP_LIMIT`` are found by running totals.
    """
    _, hits = split_hits(log, rules)
    need = F.col("min_hits").cast("bigint")
    if start_counters is not None:
        hits = hits.join(_earlier_hits(start_counters), "rule_id", "left")
        need = need - F.coalesce("__earlier", F.lit(0))
    hits = hits.select("rule_id", need.alias("need"), F.struct(*LOG_ORDER).alias("at"))
    reached = hits.where("need <= 0").select("rule_id", F.lit(None).cast(hits.schema["at"].dataType).alias("cut")).distinct()
    by_place = Window.partitionBy("rule_id").orderBy("at")
    most = hits.where("need > 0").agg(F.max("need")).first()[0] or 0
    ranked = hits.where("need > 0").withColumn("rank", F.row_number().over(by_place))
    # The constant lets the engine keep the first so many rows per rule of each task; the rule's own number decides.
    cut = ranked.where(F.col("rank") <= min(most, _GROUP_LIMIT)).where("rank = need").select("rule_id", F.col("at").alias("cut"))
    if most > _GROUP_LIMIT:
        far = hits.where(F.col("need") > _GROUP_LIMIT)
        total = running_total(far.select("rule_id", "need", "at.*"), ["rule_id"], "seq", LOG_ORDER[1:], F.lit(1), "rank")
        cut = cut.unionByName(total.where("rank = need").select("rule_id", F.struct(*LOG_ORDER).alias("cut")))
    return reached.unionByName(cut)


def enforced_blocks(log: DataFrame, rules: DataFrame, start_counters: DataFrame | None = None) -> DataFrame:
    """(seq, rule_id, enforced) for each block decision on a statement: as :func:`apply_thresholds`, without counting the
    hits of every row. Each decision is compared with the cut-off of its rule."""
    free, hits = split_hits(log, rules)
    cuts = broadcast_if_small(enforcement_cutoffs(log, rules, start_counters).withColumn("__met", F.lit(True)))
    met = hits.where("is_block").join(cuts, "rule_id", "left")
    passed = F.col("__met").isNotNull() & (F.col("cut").isNull() | (F.struct(*LOG_ORDER) >= F.col("cut")))
    return free.select("seq", "rule_id", "enforced").unionByName(met.select("seq", "rule_id", passed.alias("enforced")))


def statement_outcomes(
    log: DataFrame, rules: DataFrame, mode: str = "log", start_counters: DataFrame | None = None,
    ignored: DataFrame | None = None,
) -> DataFrame:
    """(seq, outcome, block_ignored): blocked, gated, rewritten or forwarded, and how many written cells a block rule met
    without effect (see ``ignored_blocks``; 0 when these are not given).

    Reads the log of the statements (steps 0 and 1) once per part and meets on ``seq`` in one aggregation.
    """
    no, none = F.lit(False), F.lit(0).cast("bigint")
    flags = ("seen", "enforced", "gated", "changed")

    def marks(df: DataFrame, **given) -> DataFrame:
        return df.select("seq", *[given.get(f, no).alias(f) for f in flags], given.get("ignored", none).alias("ignored"))

    parts = marks(log.where(F.col("step") == 0), seen=F.lit(True))
    if ignored is not None:
        parts = parts.unionByName(marks(ignored, ignored=F.col("n").cast("bigint")))
    if mode == "enforce":
        gates = enforced_blocks(log, rules, start_counters)
        parts = parts.unionByName(marks(gates, enforced=F.col("enforced"), gated=~F.col("enforced")))
        parts = parts.unionByName(marks(log.where(F.col("step") == 1), changed=F.lit(True)))
    met = parts.groupBy("seq").agg(*[F.max(c).alias(c) for c in flags], F.sum("ignored").alias("block_ignored"))
    outcome = (
        F.when(F.col("enforced"), F.lit("blocked"))
        .when(F.col("gated"), F.lit("gated"))
        .when(F.col("changed"), F.lit("rewritten"))
        .otherwise(F.lit("forwarded"))
    )
    return met.where("seen").select("seq", outcome.alias("outcome"), "block_ignored")


def oversized_rewrites(df: DataFrame, text_col: str, cap: int = MAX_REWRITE_BYTES) -> DataFrame:
    """Add ``rewrite_skipped_size``: the packet with this text would exceed the cap."""
    size = utf16_units(F.col(text_col)).cast("bigint") * 2 + PACKET_HEADER_BYTES
    return df.withColumn("rewrite_skipped_size", size > cap)


def sniff_counters(events: DataFrame, rules: DataFrame, env: str | None = None, form: str = "auto") -> DataFrame:
    """(key, n): outcome counters for text that looks like a statement."""
    texts = events.where(S.has_keyword(F.col("sql_text")))
    found = RuleSet.prepare(rules, env, form).match_pattern(texts, F.col("sql_text"), "__by_pattern")
    action = F.col("__by_pattern.action")
    key = (
        F.when(action == "block", F.lit("blocks"))
        .when(action == "autocorrect", F.lit("autocorrect_suggested"))
        .otherwise(F.lit("allowed"))
    )
    return found.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
