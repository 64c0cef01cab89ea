"""Rule files and declared parameter types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.operators.policy import admit_rules
from stmtgauge.operators.small import broadcast_if_small
from stmtgauge.sources.storage import if_present

RULE_FIELDS = (
    "id STRING, target STRING, selector STRING, action STRING, reason STRING, confidence DOUBLE, enabled BOOLEAN, "
    "apply_in_envs ARRAY<STRING>, min_hits_to_enforce INT"
)
RULE_SCHEMA = f"ord INT, {RULE_FIELDS}"
_RAW_FIELDS = tuple(part.split()[0] for part in RULE_FIELDS.replace("ARRAY<STRING>", "ARRAY").split(", "))
# Fields known to the older rule format; a rule with any other field was dropped there.
_OLD_FIELDS = ("id", "target", "selector", "action", "reason", "confidence", "enabled")


def _entries(text: DataFrame) -> DataFrame:
    """(ord, raw) of JSON arrays, one per file: files by path, then places in the file."""
    placed = text.select(
        F.col("_metadata.file_path").alias("__path"), F.posexplode(F.from_json("value", "ARRAY<STRING>")).alias("ord", "raw")
    )
    if len(text.inputFiles()) <= 1:
        return placed.select("ord", "raw")
    counts = placed.groupBy("__path").agg(F.count("*").alias("n")).orderBy("__path").collect()  # a row per file
    first = [(r["__path"], sum(c["n"] for c in counts[:i])) for i, r in enumerate(counts)]
    starts = broadcast_if_small(text.sparkSession.createDataFrame(first, "__path STRING, __start INT"))
    return placed.join(starts, "__path").select((F.col("__start") + F.col("ord")).alias("ord"), "raw")


def read_raw_rules(spark: SparkSession, path: str) -> DataFrame:
    """(ord, one text column per field): every field as JSON text, NULL when absent, for ``policy.validate_rules``."""
    entries = _entries(spark.read.text(path, wholetext=True))
    # A variant keeps the JSON type of each field.
    fields = F.try_parse_json("raw")
    return entries.select(
        "ord", *[F.to_json(F.try_variant_get(fields, f"$.{f}", "variant")).alias(f) for f in _RAW_FIELDS]
    )


def read_rules(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """Admitted rules of a JSON array file in file order, or of a folder of such files in order of their names; a missing
    file gives no rules.

    ``compat`` also drops rules with fields beyond the older format.
    """
    text = if_present(lambda: spark.read.text(path, wholetext=True))
    if text is None:
        return spark.createDataFrame([], RULE_SCHEMA)
    entries = _entries(text)
    if compat:
        keys = F.json_object_keys("raw")
        known = F.array(*[F.lit(k) for k in _OLD_FIELDS])
        entries = entries.where(F.size(F.array_except(keys, known)) == 0)
    rules = entries.select("ord", F.from_json("raw", RULE_FIELDS).alias("r")).select("ord", "r.*")
    return admit_rules(rules)


def read_param_types(spark: SparkSession, path: str) -> DataFrame:
    """(proc, param, type) of ``{proc: {param: type}}``; names in lower case, at-signs removed from parameters."""
    schema = "proc STRING, param STRING, type STRING"
    text = if_present(lambda: spark.read.text(path, wholetext=True))
    if text is None:
        return spark.createDataFrame([], schema)
    parsed = text.select(
        F.explode(F.from_json("value", "MAP<STRING, MAP<STRING, STRING>>")).alias("proc", "params")
    )
    return parsed.select(F.lower("proc").alias("proc"), F.explode("params").alias("param", "type")).select(
        "proc", F.lower(F.ltrim("param", F.lit("@"))).alias("param"), "type"
    )
