"""Reports as tables of ordered lines: (section, place, name, sub, line).

``section`` numbers the parts, ``place`` and ``name`` order the entries of a part, ``sub`` orders lines of one entry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.operators import decisions as D
from stmtgauge.operators import profiles as P

SAMPLE_LINE_CHARS = 160
PROFILE_CONTEXT_ROWS = 50
INSIGHT_CONTEXT_ROWS = 30


def _fixed(spark: SparkSession, section: int, *lines: str) -> DataFrame:
    """Headings and blank lines; they come before the entries of their section."""
    rows = [(section, -(10**9) + i, "", 0, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "section INT, place BIGINT, name STRING, sub INT, line STRING")


def _heading_if_any(df: DataFrame, section: int, *lines: str) -> DataFrame:
    """Headings of a section that is left out when ``df`` has no row."""
    texts = F.array(*[F.lit(line) for line in lines])
    heads = df.limit(1).select(F.posexplode(texts).alias("sub", "line"))
    return _entries(heads, section, F.lit(-(10**9)), F.lit(""), F.col("line"), F.col("sub"))


def _entries(df: DataFrame, section: int, place: Column, name: Column, line: Column, sub: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        place.cast("bigint").alias("place"),
        name.alias("name"),
        (F.lit(0) if sub is None else sub).cast("int").alias("sub"),
        line.alias("line"),
    )


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _joined_counts(counts: DataFrame, group: str, label: str, *order: Column) -> DataFrame:
    """One row per group with ``label:n`` pairs joined in order; a rule has few actions, a table few top columns."""
    pairs = F.sort_array(F.collect_list(F.struct(*order, F.concat_ws(":", label, "n").alias("pair"))))
    return counts.groupBy(group).agg(F.array_join(F.transform(pairs, lambda p: p["pair"]), ", ").alias("pairs"))


def _null_lines(top: DataFrame, section: int, template: str) -> DataFrame:
    return _entries(
        top, section, -F.col("nulls"), F.col("field"), F.format_string(template, "field", "nulls", "count")
    )


def daily_report(
    spark: SparkSession, day: str, profiles: DataFrame, usage: DataFrame, previous: DataFrame | None = None
) -> DataFrame:
    """Data-quality report: missing values, format issues, SELECT usage, drift.

    ``profiles`` and ``previous`` as from ``field_profiles``, ``usage`` as from ``select_usage``.
    """
    top = P.top_suggestions(profiles)
    issues = _entries(
        top, 2, -F.col("total"), F.col("field"), F.format_string("- %s: %d suggestions (%s)", "field", "total", "kinds")
    )
    stars = usage.groupBy("table").agg(F.sum("star").alias("star"))
    columns = _joined_counts(P.top_select_columns(usage), "table", "expression", F.col("rank"))
    tables = stars.join(columns, "table", "left")
    selects = _entries(
        tables,
        3,
        F.lit(0),
        F.col("table"),
        F.format_string(
            "- %s: select_star=%d, top_columns=[%s]", "table", "star", F.coalesce("pairs", F.lit("")).alias("pairs")
        ),
    )
    parts = [
        # Headings and line formats of the report.
        _fixed(spark, 1, f"# Daily Data Quality Report – {day}", "", "## Top Missingness"),
        _null_lines(P.top_nulls(profiles), 1, "- %s: nulls=%d / count=%d"),
        _fixed(spark, 2, "", "## Format Issues & Suggestions"),
        issues,
        _heading_if_any(usage, 3, "", "## SELECT Analysis"),
        selects,
        _fixed(spark, 4, "", "## Drift & Errors"),
    ]
    if previous is None:
        parts.append(_fixed(spark, 5, "- TODO: compute PSI/KL and error trends once enough history is available."))
    else:
        drift = P.null_drift(previous, profiles).limit(10)
        line = F.format_string("- %s: null_ratio drift %.2f", "field", "drift")
        parts.append(_entries(drift, 5, -(F.col("drift") * 10**9), F.col("field"), line))
    return _all(*parts)


def _rule_sections(spark: SparkSession, decisions: DataFrame, order: tuple[str, ...]) -> DataFrame:
    counts = D.counts_by_rule(decisions)
    lines = _joined_counts(counts, "rule", "action", (-F.col("n")).alias("k"), F.col("action"))
    rules = _entries(lines, 2, F.lit(0), F.col("rule"), F.format_string("- %s: %s", "rule", "pairs"))
    samples = D.samples_by_rule(decisions, D.first_sample(), order).where(F.col("sample") != "")
    clean = F.left(F.replace("sample", F.lit("\n"), F.lit(" ")), F.lit(SAMPLE_LINE_CHARS))
    texts = _entries(samples, 2, F.lit(0), F.col("rule"), F.concat(F.lit("  - sample: "), clean), F.col("rank"))
    return _all(_fixed(spark, 2, "", "## By Rule"), rules, texts)


def dryrun_report(spark: SparkSession, day: str, decisions: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Summary of one day of decisions: totals, counts by rule, samples. Rules come in name order."""
    totals = D.totals_by_action(decisions)
    return _all(
        # Headings and line formats of the report.
        _fixed(spark, 1, f"# Dry‑Run Enforcement Summary – {day}", "", "## Totals by Action"),
        _entries(totals, 1, -F.col("n"), F.col("action"), F.format_string("- %s: %d", "action", "n")),
        _rule_sections(spark, decisions, order),
    )


def evaluation_report(spark: SparkSession, stamp: str, totals: DataFrame, counts: DataFrame) -> DataFrame:
    """Outcome of evaluating rules over events: totals and counts by rule, actions in name order."""
    lines = _joined_counts(counts, "rule", "action", F.col("action"))
    return _all(
        # Headings and line formats of the report.
        _fixed(spark, 1, f"# Dry‑Run Simulation – {stamp}", "", "## Totals by Action"),
        _entries(totals, 1, F.lit(0), F.col("action"), F.format_string("- %s: %d", "action", "n")),
        _fixed(spark, 2, "", "## By Rule"),
        _entries(lines, 2, F.lit(0), F.col("rule"), F.format_string("- %s: %s", "rule", "pairs")),
    )


def _profile_lines(profiles: DataFrame, section: int, rows: int, template: str) -> DataFrame:
    """The first profiles in name order with their number of suggestions."""
    first = profiles.orderBy("field").limit(rows)
    total = P.total_suggestions(F.col("suggestions"))
    return _entries(
        first.withColumn("total", total), section, F.lit(0), F.col("field"),
        F.format_string(template, "field", "count", "nulls", "total"),
    )


def insight_context(spark: SparkSession, day: str, decisions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Facts to write insights from: acting verdicts by rule and the first profiles."""
    context = D.rule_context(decisions)
    template = "- %s: {'block': %d, 'autocorrect': %d, 'rpc_autocorrect_inplace': %d}"
    rules = F.format_string(template, "rule", *D.CONTEXT_ACTIONS)
    return _all(
        # Headings and line formats of the context.
        _fixed(spark, 1, f"Decisions by rule (today {day}):"),
        _entries(context, 1, F.lit(0), F.col("rule"), rules),
        _fixed(spark, 2, "Top profiles:"),
        _profile_lines(profiles, 2, INSIGHT_CONTEXT_ROWS, "- %s: count=%d nulls=%d sugg=%d"),
    )


def insight_fallback(spark: SparkSession, day: str) -> DataFrame:
    """Standing advice for a day on which nobody wrote insights."""
    # The advice.
    return _fixed(
        spark,
        1,
        f"# Insights – {day}",
        "",
        "- Increase validation on fields with repeated autocorrect events.",
        "- Address top missingness columns via UI hints.",
        "- Align phone/country formats across services.",
    )


def profile_context(profiles: DataFrame) -> DataFrame:
    """Facts to write a profile summary from."""
    return _profile_lines(profiles, 1, PROFILE_CONTEXT_ROWS, "- %s: count=%d nulls=%d suggestions=%d")


def profile_summary(spark: SparkSession, profiles: DataFrame) -> DataFrame:
    """Plain summary: five fields with most missing values and five with most format issues."""
    issues = P.top_suggestions(profiles, 5)
    return _all(
        # Headings and line formats of the summary.
        _fixed(spark, 1, "Top Missingness:"),
        _null_lines(P.top_nulls(profiles, 5), 1, "- %s: nulls=%d count=%d"),
        _fixed(spark, 2, "", "Format Issues:"),
        _entries(issues, 2, -F.col("total"), F.col("field"), F.format_string("- %s: %d suggestions", "field", "total")),
    )
