"""Report sink: ordered lines as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

LINE_ORDER = ("section", "place", "name", "sub")


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines in order. A range sort keeps the parts in order, so a long report needs no single task."""
    lines.orderBy(*LINE_ORDER).select("line").write.mode("overwrite").text(path)
