"""Shards that all hold the same mixture of sources, by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.llm.common import materialize, small, table
from stmtgauge.llm.order import running

SHARDS, SEED = 8, 17


def interleaved_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``shard`` and ``slot`` for every row of
    documents.

    Rows are shuffled by a seeded hash inside their source and ranked; row ``r`` of the ``n`` of its source gets the
    fractional rank ``(r + 1/2) / n``. All rows sorted by it interleave the sources in proportion, and the order is cut
    into ``shards`` stretches whose row counts differ by one at most (law ``rows``), so each shard holds of each source
    its share, up to a row or two. ``slot`` counts from 0 inside the shard.

    Null text counts as empty (size 1, crc32 0); a null source is a source of its own, a null doc_id an id like any
    other. Ties of the hash are broken by doc_id and crc32; rows that still tie are alike in all that is returned.
    Copies of a text are not kept together: that would break equal counts. No rows give no rows. Only ids, sizes and
    checksums are shuffled, never texts.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "source",
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    narrow = materialize(narrow, "documents")
    sources = narrow.groupBy("source").agg(F.count("*").alias("n"))
    sources = materialize(sources.withColumn("s", F.monotonically_increasing_id()), "sources")
    n_sources, rows = sources.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    by_source = small(sources, n_sources, 256)
    numbered = narrow.join(by_source, narrow["source"].eqNullSafe(sources["source"])).select(narrow["*"], "s", "n")
    ranked = running(numbered.withColumn("one", F.lit(1).cast("bigint")), "s", ["h", "doc_id", "text_crc32"], "one")
    mixed = ranked.select(
        "doc_id", "source", "size", "text_crc32", "one", "h",
        ((F.col("rank") + 0.5) / F.col("n")).alias("fraction"), F.lit(0).cast("bigint").alias("all"),
    )
    tie = F.xxhash64("h", F.lit(seed + 1))
    placed = running(mixed.withColumn("tie", tie), "all", ["fraction", "tie", "doc_id", "text_crc32"], "one")
    shard = F.expr(f"(rank * {shards}) DIV {max(rows, 1)}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) DIV {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("rank") - first)
        .select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
