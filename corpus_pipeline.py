"""From documents to token ids: each stage is one operator of ``stmtgauge.llm``, written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.llm import line_quality, mixing, near_copies, substring
from stmtgauge.llm.byte_bpe import encoded
from stmtgauge.llm.common import spread, table, written
from stmtgauge.sources.storage import remove


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go. It learns from the labels of the documents it is given."""
    model = line_quality.fit(docs, table(spark, sf_dir, "labels"))
    names = {c: f"__{c}_given" for c in ("held_out", "score", "predicted")}
    scored = line_quality.scored(spread(docs.withColumnsRenamed(names)), model).where("predicted = 1")
    return scored.drop(*names).withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: one document of each group of five-word shingle similarity 0.8 or more stays."""
    return near_copies.one_of_each_group(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words of windows that an earlier document holds are cut from the text; every document stays."""
    names = {c: f"__{c}_given" for c in ("n_words", "n_removed", "kept_sha256")}
    cut = substring.without_repeats(docs.withColumnsRenamed(names)).drop(*names)
    cut = cut.withColumnsRenamed({v: k for k, v in names.items()})
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint")))
    return cut.select(*docs.columns)


def weighted_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mixture of sources takes it, also not at all."""
    return mixing.mixture(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of every text, their number, and digests of the ids and of what they decode to."""
    narrow = spread(docs.select("doc_id", "lang", "source", "text"))
    return encoded(narrow, public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("text")


STAGES = [
    ("quality classifier", good_documents),
    ("near-dedup", without_near_copies),
    ("substring dedup", without_repeated_passages),
    ("mixing sources to target weights", weighted_mixture),
    ("byte-level BPE encoding and decoding", token_ids),
]
#: No stage can be said in SQL: they train a classifier, hash shingles and run tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it; what a stage wrote goes when
    the next one has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), "stage")
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
