"""Positions and running sums in a global order, without one task that sees all rows of a group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtgauge.llm.common import materialize, partitions, schema_with, small


def running(df: DataFrame, group: str, order: Sequence[str], weight: str) -> DataFrame:
    """Add ``rank`` (rows of the group before this one) and ``before`` (sum of ``weight`` over them), both BIGINT.

    ``group`` is a BIGINT without nulls, ``weight`` a BIGINT without nulls. Rows are dealt out by range of (group,
    order), so a group of any size spreads over many tasks; each task counts along its own stretch, and what the tasks
    before it hold of the same group is added from a table with one row per task and group in it. The rows are written
    once in between, so a lost executor cannot change the order between the two steps.
    """
    n = partitions(df)
    placed = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    schema = schema_with(df, __task="int", __rank="bigint", __before="bigint")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, last, rows, total = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            g, w = batch[group].to_numpy(np.int64), batch[weight].to_numpy(np.int64)
            if g[0] != last:
                rows, total = 0, 0
            head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.diff(np.r_[head, len(g)])
            sums = np.cumsum(w) - w
            rank = np.arange(len(g)) - np.repeat(head, size)
            before = sums - np.repeat(sums[head], size)
            rank[: size[0]] += rows
            before[: size[0]] += total
            last, rows, total = g[-1], int(rank[-1]) + 1, int(before[-1] + w[-1])
            yield batch.assign(__task=task, __rank=rank, __before=before)

    counted = materialize(placed.mapInPandas(count, schema), "ordered")
    totals = counted.groupBy("__task", group).agg(F.count("*").alias("__n"), F.sum(weight).alias("__w"))
    earlier = Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__task",
        group,
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"),
        F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("__w"),
    )
    offsets = small(offsets, totals.count(), 64)
    return counted.join(offsets, ["__task", group]).select(
        *df.columns, (F.col("__rank") + F.col("__n")).alias("rank"), (F.col("__before") + F.col("__w")).alias("before")
    )
