"""Running totals that stay distributed when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BITS = 16
_BEFORE = (Window.unboundedPreceding, -1)


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], value: Column, out: str, total: str = ""
) -> DataFrame:
    """Add ``out``: sum of ``value`` over the rows of the same keys up to and including this one.

    With ``total`` also add the sum over all rows of the keys.

    ``order`` is a BIGINT column; ``ties`` order rows that share it. A plain running window would send a hot key to one
    task. Here windows run inside blocks of 2^16 consecutive order values; totals of earlier blocks come from two more
    levels of the same kind over per-block sums, which are pre-aggregated before their shuffle. No window group holds
    more than 2^16 order values (the top level: one row per 2^32 values), whatever the distribution.
    """
    rows = df.withColumn("__block", F.shiftright(F.col(order), _BITS)).withColumn("__value", value)
    inside = (
        Window.partitionBy(*keys, "__block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    )
    blocks = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum"))
    blocks = blocks.withColumn("__super", F.shiftright("__block", _BITS))
    supers = blocks.groupBy(*keys, "__super").agg(F.sum("__sum").alias("__sum"))

    totals = {total: F.sum("__sum").over(Window.partitionBy(*keys))} if total else {}
    same = lambda left, right, names: [left[n].eqNullSafe(right[n]) for n in names]  # noqa: E731  NULL is a key as well
    before_super = supers.select(
        *keys,
        "__super",
        F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__super").rowsBetween(*_BEFORE)).alias("__before2"),
        *[c.alias(name) for name, c in totals.items()],
    )
    inside_super = Window.partitionBy(*keys, "__super").orderBy("__block").rowsBetween(*_BEFORE)
    inner = blocks.withColumn("__before1", F.sum("__sum").over(inside_super))
    before_block = (
        inner.join(before_super, same(inner, before_super, [*keys, "__super"]))
        .select(
            *[inner[k] for k in keys],
            "__block",
            (F.coalesce("__before1", F.lit(0)) + F.coalesce("__before2", F.lit(0))).alias("__before"),
            *totals,
        )
    )
    counted = rows.withColumn(out, F.sum("__value").over(inside))
    met = counted.join(before_block, same(counted, before_block, [*keys, "__block"]))
    return met.select(
        *[counted[c] for c in df.columns if c not in (out, *totals)], (F.col(out) + F.col("__before")).alias(out), *totals
    )
