"""Mix sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stmtgauge.llm.common import materialize, schema_with, small, spread, table, texts_of, with_columns
from stmtgauge.llm.order import running

WEIGHTS, CAP, SEED = (5.0, 2.0, 1.0), 3.0, 11
#: A document's sampling weight is never below this, so that every document can be drawn.
LEAST_WEIGHT = 0.05
_PLAIN = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)) + b" \t\n\x0b\x0c\r,.'"


def quality(text: bytes) -> float:
    """A document's sampling weight: its share of letters and plain punctuation, times its share of distinct lines."""
    if not text:
        return LEAST_WEIGHT
    lines = text.split(b"\n")
    odd = len(text.translate(None, _PLAIN)) / len(text)
    return max(LEAST_WEIGHT, (1 - odd) * len(set(lines)) / len(lines))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``size`` (words ``[^\\x20\\x09-\\x0D]+``, null text 0) and ``weight`` of every row; replaces such columns."""
    kept = docs.select(*[c for c in docs.columns if c not in ("size", "weight")])

    def run(batches):
        for batch in batches:
            size, weight = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows)
            for i, t in enumerate(texts_of(batch, text)):
                size[i], weight[i] = len(t.split()), quality(t)
            yield with_columns(batch, {"size": pa.array(size), "weight": pa.array(weight)})

    return kept.mapInArrow(run, schema_with(kept, size="bigint", weight="double"))


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add ``target`` to sources (``source``, ``source_size``): shares of the whole size by weight, each at most ``cap``
    times its source; what a source cannot take goes to the others by weight until none is above.

    Weights repeat along the sources by code point, null last. The water level is found in closed form: with sources
    sorted by cap per weight, it lies at the first one where raising all to its own level would use up everything (later
    ones give lower levels, hence the maximum). The
    windows see one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    named = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    named = named.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("level", F.col("most") / F.col("w"))
    up = Window.orderBy("level", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    filled = F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    found = named.select("*", filled.alias("filled"), rest.alias("rest"), F.sum("source_size").over(whole).alias("all"))
    reached = F.col("filled") + F.col("level") * F.col("rest") >= F.col("all")
    water = F.max(F.when(reached, (F.col("all") - F.col("filled")) / F.col("rest"))).over(whole)
    return found.withColumn("water", water).select(
        "source", "source_size", F.least("most", F.coalesce(F.col("water") * F.col("w"), "most")).alias("target")
    )


def _after(gap: DataFrame, rows: DataFrame) -> DataFrame:
    """``gap`` of each ``s`` less the sizes of the ``drawn`` rows."""
    used = rows.where("drawn").groupBy("s").agg(F.sum("size").alias("used"))
    less = gap.join(used, "s", "left").select("s", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
    return materialize(less, "gaps")


def _closed(left: DataFrame, gap: DataFrame, n: int, turn: int) -> DataFrame:
    """How each source's gap is closed by at most two of the rows ``left``: the largest that fits, then the nearest from
    either side; of equal ones the earliest. ``open`` if something fits and no less than the smallest row is missed."""
    found = F.struct("place", "size")
    fitting = left.join(small(gap, n, 64), "s").where("size <= gap")
    one = materialize(fitting.groupBy("s").agg(F.max_by(found, F.struct("size", -F.col("place"))).alias("one")), "filled")
    rest = (F.col("gap") - F.coalesce("one.size", F.lit(0))).alias("gap")
    gap2 = gap.join(one, "s", "left").select("s", rest, F.col("one.place").alias("one"))
    nearer = left.join(small(gap2, n, 64), "s").where("size < 2 * gap AND NOT place <=> one")
    two = nearer.groupBy("s").agg(F.min_by(found, F.struct(F.abs(F.col("size") - F.col("gap")), "place")).alias("two"))
    least = left.groupBy("s").agg(F.min("size").alias("least"))
    miss = F.abs(F.col("gap") - F.coalesce("two.size", F.lit(0)))
    closed = gap2.join(two, "s", "left").join(least, "s", "left").select(
        "s", F.lit(turn).alias("turn"), miss.alias("miss"), F.array_compact(F.array("one", "two.place")).alias("places"),
        F.coalesce(F.col("one").isNotNull() & (miss >= F.col("least")), F.lit(False)).alias("open"),
    )
    return materialize(closed, "closed")


def mixed(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = SEED, row: str | None = None
) -> DataFrame:
    """How often each document is taken: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and
    ``taken`` (= copies x size); ``row``, if a BIGINT column of ``docs`` is named, identifies the row.

    A source whose target is ``e`` times its size and a rest is taken ``e`` times as a whole (complete epochs); the rest
    is drawn without replacement: document ``d`` of weight ``w`` has the key ``-ln(u) / w`` with ``u`` a seeded hash of
    its id and text, and documents are taken by rising key as long as their running size stays within the rest. The gap
    before the first document that does not fit is then filled by up to two more: the largest that still fits, and the
    one that brings the source nearest to its target from either side (smallest key first). Where that leaves a gap, as
    before a very long document, documents are taken on by rising key past those that do not fit, and the gap is closed
    in the same way where that comes nearest to the target.

    Null text has size 0 and is never taken as a fraction; a null source is a source, last in order; null ids take part.
    Repeated rows have the same key and lie side by side. Sources of size 0 have target 0. No rows give no rows. Sizes
    and keys are shuffled, texts are not.
    """
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "source",
        "text",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        (F.col(row) if row else F.lit(0)).cast("bigint").alias("row"),
    )
    sized = materialize(measured(spread(narrow)).drop("text"), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, cap).withColumn("s", F.monotonically_increasing_id())
    targets = materialize(
        targets.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "targets",
    )
    by_source = small(targets, targets.count(), 256)
    joined = sized.join(by_source, sized["source"].eqNullSafe(targets["source"])).select(
        sized["*"], "s", "source_size", "target", "epochs", "rest"
    )
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11) + 0.5) * F.lit(2.0**-53)
    keyed = joined.withColumn("key", -F.log(u) / F.col("weight"))
    ordered = materialize(running(keyed, "s", ["key", "doc_id", "text_hash"], "size"), "drawn")
    picked = ordered.withColumn("drawn", (F.col("before") + F.col("size") <= F.col("rest")) & (F.col("size") > 0))
    n = targets.count()
    gap = _after(targets.select("s", F.col("rest").alias("gap")), picked)
    left = picked.where("NOT drawn AND size > 0").select("s", F.col("rank").alias("place"), "size")
    turn, drawn = 0, []
    closed = [_closed(left, gap, n, turn)]
    # A document that does not fit is passed over: where the gap stays open, sums go on over what fits into it.
    while not (still := closed[-1].where("open").select("s")).isEmpty():
        left = left.join(small(gap.join(still, "s"), n, 64), "s").where("size < 2 * gap")
        left = left.withColumn("fitting", F.when(F.col("size") <= F.col("gap"), F.col("size")).otherwise(0))
        summed = running(left, "s", ["place"], "fitting")
        fits = (F.col("size") <= F.col("gap")) & (F.col("before") + F.col("size") <= F.col("gap"))
        summed = materialize(summed.select("s", "place", "size", fits.alias("drawn")), "drawn")
        gap = _after(gap.join(still, "s"), summed)
        drawn.append(summed.where("drawn").select("s", "place", F.lit(turn).alias("turn")))
        left, turn = summed.where("NOT drawn").select("s", "place", "size"), turn + 1
        closed.append(_closed(left, gap, n, turn))
    # Of the turns at which a source could stop, the one that comes nearest; the first of equal ones.
    best = reduce(DataFrame.unionByName, closed).groupBy("s").agg(
        F.min_by(F.struct("turn", "places"), F.struct("miss", "turn")).alias("b")
    )
    best = materialize(best.select("s", F.col("b.turn").alias("last"), F.col("b.places").alias("places")), "closed")
    more = [best.select("s", F.explode("places").alias("place"))]
    more += [d.join(small(best, n, 64), "s").where("turn < last").select("s", "place") for d in drawn]
    more = materialize(reduce(DataFrame.unionByName, more), "filled")
    more = small(more.select("s", F.col("place").alias("rank"), F.lit(True).alias("extra")), more.count(), 32)
    taken = picked.join(more, ["s", "rank"], "left")
    copies = F.col("epochs") + F.when(F.col("drawn") | F.coalesce("extra", F.lit(False)), 1).otherwise(0)
    return taken.withColumn("copies", copies.cast("int")).select(
        "doc_id", "row", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"),
    )


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Texts are written once with a row number, and shuffled once
    to meet their number of copies."""
    named = docs.withColumnsRenamed({"__row": "__row_given"}).withColumn("__row", F.monotonically_increasing_id())
    held = materialize(named, "documents")
    copies = mixed(held, row="__row").where("copies > 0").select(F.col("row").alias("__row"), F.col("copies").alias("__n"))
    taken = held.join(copies, "__row").withColumn("__n", F.explode(F.sequence(F.lit(1), "__n")))
    return taken.drop("__row", "__n").withColumnsRenamed({"__row_given": "__row"}).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
