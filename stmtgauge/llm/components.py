"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtgauge.llm.common import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of ``edges`` (``a``, ``b`` BIGINT).

    Loops, repeated edges and edges with a null end are harmless; nodes without an edge are not in the result; no
    edges give no rows. Each round writes its edges to the shared folder, which cuts the lineage; only their number and
    a checksum reach the driver. A star of any size costs one row per leaf: minima are pre-aggregated, and the join back
    on a hot centre may be split by the engine.
    """
    edges = edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.isnull("a") | F.isnull("b")).alias("__n")
    )
    edges = materialize(edges.where("NOT __n AND a <> b").select("a", "b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        small = small.where("a <> b").distinct()
        # Large star: larger neighbours of a node move to the smallest node around it.
        both = small.unionByName(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = materialize(large, "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
