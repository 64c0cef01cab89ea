"""Column-cleaning jobs: suggest and apply value normalizations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtgauge.functions import normalizers as N
from stmtgauge.operators.once import once

SUGGESTION_TYPE = "struct<kind:string,normalized:string,hint:string>"

_TMP = ("__kind", *("__" + name for name in N.FORM_NAMES))


def _with_forms(df: DataFrame, value_col: str) -> DataFrame:
    for stage in N.cleaned_forms(F.col(value_col)):
        df = df.withColumns(stage)
    return df


def _forms(value_col: str) -> N.Forms:
    return N.shared_forms(F.col(value_col))


def normalize_as(df: DataFrame, value_col: str, kind: str, out: str = "normalized") -> DataFrame:
    """Add ``out``: the value normalized as one given kind, NULL where it is not of that kind."""
    return once(_with_forms(df, value_col), {out: N.normalized(kind, _forms(value_col))}).drop(*_TMP)


def suggest_kind(df: DataFrame, value_col: str, out: str = "kind") -> DataFrame:
    """Add only the kind of the first normalization that applies: enough for counting, cheaper than the full struct."""
    return once(_with_forms(df, value_col), {out: N.first_kind(_forms(value_col))}).drop(*_TMP)


def suggest_normalizations(df: DataFrame, value_col: str, out: str = "suggestion") -> DataFrame:
    """Add ``out``: struct (kind, normalized, hint) of the first kind that applies, else NULL."""
    forms = _forms(value_col)
    # The long chain of tests runs once, then the branch of the found kind renders, once.
    found = once(_with_forms(df, value_col), {"__kind": N.first_kind(forms)})
    kind = F.col("__kind")
    rendered = once(found, {"__normalized": F.when(kind.isNotNull(), N.normalized_as(kind, forms))})
    value = F.struct(
        kind.alias("kind"), F.col("__normalized").alias("normalized"), N.hint_of(kind).alias("hint")
    )
    return rendered.withColumn(out, F.when(kind.isNotNull(), value)).drop(*_TMP, "__normalized")


def normalize_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Clean table columns in place: ``{column: kind}`` or ``{column: "auto"}``.

    Values that do not fit their kind stay as they are.
    """
    for name, kind in columns.items():
        if kind == "auto":
            df = suggest_normalizations(df, name, "__suggestion")
            df = df.withColumn(name, F.coalesce(F.col("__suggestion.normalized"), F.col(name))).drop("__suggestion")
        else:
            df = normalize_as(df, name, kind, "__normalized")
            df = df.withColumn(name, F.coalesce(F.col("__normalized"), F.col(name))).drop("__normalized")
    return df
