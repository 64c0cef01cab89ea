"""Normalizers against stated pairs and against a plain statement of the rules on random strings."""

from __future__ import annotations

import datetime
import decimal
import random
import re

import pytest
from pyspark.sql import functions as F

from stmtgauge.functions.normalizers import SUGGESTION_ORDER
from stmtgauge.operators.normalize import normalize_as, normalize_columns, suggest_kind, suggest_normalizations

PAIRS = [
    ("date", "1/2/24", "2024-02-01"),
    ("date", "2024-12-31", "2024-12-31"),
    ("date", " 31-12-999 ", "20999-12-31"),
    ("date", "99/99/2020", "2020-99-99"),
    ("date", "2024-1-1", None),
    ("phone", "070 123 45 67", "+46701234567"),
    ("phone", "0046 (0)8-12", "+468-12"),
    ("phone", "0047 123", None),
    ("phone", "70123", None),
    ("postal", "123 45", "12345"),
    ("postal", "1234", None),
    ("email", " TEST@EXAMPLE.COM", "test@example.com"),
    ("email", "a@b", None),
    ("country_iso", "se", "SE"),
    ("country_iso", "Sweden", "SE"),
    ("country_iso", "uk", "UK"),
    ("country_iso", "atlantis", None),
    ("orgnr", "16 1234567890", "1234567890"),
    ("orgnr", "17 1234567890", None),
    ("decimal", "1 234,50", "1234.50"),
    ("decimal", "1234.5", "1234.5"),
    ("decimal", "1,2,3", None),
    ("decimal", "1\u00a0234", None),
    ("decimal", "-0", "-0"),
    ("decimal", "NaN", "NaN"),
    ("decimal", "-inf", "-Infinity"),
    ("decimal", "123456789012345678901234567890123456789012345.10", "123456789012345678901234567890123456789012345.10"),
    ("uuid", "{550E8400-E29B-41D4-A716-446655440000}", "550e8400-e29b-41d4-a716-446655440000"),
    ("uuid", "urn:uuid:550e8400e29b41d4a716446655440000", "550e8400-e29b-41d4-a716-446655440000"),
    ("uuid", "550e8400", None),
    ("datetime", "2024-8-5 7:03", "2024-08-05T07:03:00"),
    ("datetime", "2024/08/05 07:03:09.123", "2024-08-05T07:03:09"),
    ("datetime", "5-8-2024 7:03:01", "2024-08-05T07:03:01"),
    ("datetime", "2024-02-30 07:03", None),
    ("datetime", "2024-08-05 07:03:60", None),
    ("datetime", "2024-08-05 07:03:09.1234567", None),
    ("datetime", "2024-8-5 7:03 and more", "2024-08-05T07:03:00"),
    ("datetime", "2024-08-05 07:03 and more", None),
]


@pytest.mark.parametrize("kind", sorted({k for k, _, _ in PAIRS}))
def test_stated_pairs(spark, kind):
    pairs = [(v, e) for k, v, e in PAIRS if k == kind]
    got = normalize_as(spark.createDataFrame(pairs, "v STRING, expected STRING"), "v", kind).collect()
    assert [(r.v, r.normalized) for r in got] == [(r.v, r.expected) for r in got]


def test_first_kind_wins(spark):
    cases = [
        ("31/12/24", "date"), ("0.5", "phone"), ("01234", "phone"), ("5566778899", "decimal"), ("556677-8899", "orgnr"),
        ("1234.5", "decimal"), ("12345", "postal"), ("hello", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame(cases, "v STRING, expected STRING")
    for row in suggest_normalizations(df, "v").collect():
        assert (row.suggestion.kind if row.suggestion else None) == row.expected, row.v
    for row in suggest_kind(df, "v").collect():
        assert row.kind == row.expected
    hint = suggest_normalizations(df.where("v = '12345'"), "v").first().suggestion.hint
    assert hint == "Use 5 digits without spaces"


# -- a plain statement of the rules ---------------------------------------------------------------------------------
def plain_decimal(v):
    v = v.strip().replace(" ", "").replace("_", "")
    v = v if "." in v else v.replace(",", ".")
    if re.search(r"[eE][-+]?0*\d{6}", v):
        return None
    try:
        return f"{decimal.Decimal(v):f}"
    except decimal.InvalidOperation:
        return None


def plain_moment(v):
    v = v.strip().replace("/", "-")
    head, *rest = v.split(" ")
    pieces = head.split("-")
    if len(pieces) == 3 and 1 in (len(pieces[1]), len(pieces[2])):
        v = " ".join(["-".join([pieces[0], pieces[1].zfill(2), pieces[2].zfill(2)]), *rest[:1]])
    clock = ["%H:%M", "%H:%M:%S", "%H:%M:%S.%f"]
    shapes = [f"%Y-%m-%d{sep}{c}" for sep in "T " for c in clock] + [f"%d-%m-%Y {c}" for c in clock[:2]]
    for shape in shapes:
        try:
            return datetime.datetime.strptime(v, shape).isoformat(timespec="seconds")
        except ValueError:
            pass
    return None


def random_values(alphabet, seeds, n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        text = list(rng.choice(seeds))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            if rng.random() < 0.5 and at < len(text):
                text[at] = rng.choice(alphabet)
            else:
                text.insert(at, rng.choice(alphabet))
        out.add("".join(text))
    return sorted(out)


def test_decimals_match_the_plain_rule(spark):
    seeds = ["1", "12.5", "0012.50", "1.5e-3", "-7e2", "0.0e5", "1 234,50", "inf", "nan12", "snan", "+.5e1", "1_000"]
    values = random_values("0123456789.,-+eE _nai", seeds, 1500, 7)
    got = normalize_as(spark.createDataFrame([(v,) for v in values], "v STRING"), "v", "decimal").collect()
    assert {r.v: r.normalized for r in got} == {v: plain_decimal(v) for v in values}


def test_moments_match_the_plain_rule(spark):
    seeds = ["2024-8-5 7:03", "2024-02-29T23:59:59.5", "5/8/2024 07:03:10", "2023-12-1 1:2:3", "2024-08- 5 07:03", "0001-01-01 00:00"]
    values = random_values("0123456789-/:T .", seeds, 1500, 11)
    got = normalize_as(spark.createDataFrame([(v,) for v in values], "v STRING"), "v", "datetime").collect()
    assert {r.v: r.normalized for r in got} == {v: plain_moment(v) for v in values}


def test_columns_are_cleaned_in_place(spark):
    df = spark.createDataFrame([("070-1", "Sweden", 1), ("x", "nowhere special", 2)], "phone STRING, any STRING, n INT")
    rows = normalize_columns(df, {"phone": "phone", "any": "auto"}).orderBy("n").collect()
    assert [(r.phone, r.any) for r in rows] == [("+4670-1", "SE"), ("x", "nowhere special")]


def test_expressions_run_once_and_stay_in_generated_code(spark):
    df = spark.createDataFrame([("1",)], "v STRING")
    plan = suggest_kind(df, "v").where(F.col("kind").isNotNull())._jdf.queryExecution().executedPlan().toString()
    assert len(SUGGESTION_ORDER) == 9
    # The mail pattern appears in one operator only: the filter did not repeat it.
    assert plan.count("[^@") <= 3


def _standard(kind, value):
    """What the standard parsers make of a value."""
    from datetime import datetime
    from decimal import Decimal, InvalidOperation
    from uuid import UUID

    if kind == "decimal":
        text = value.strip().replace(" ", "").replace("_", "")
        text = text.replace(",", ".") if "." not in text else text
        try:
            return format(Decimal(text), "f")
        except InvalidOperation:
            return None
    if kind == "uuid":
        try:
            return str(UUID(value.strip().lower().strip("{}() ")))
        except ValueError:
            return None
    text = value.strip().replace("/", "-")
    for shape in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%d-%m-%Y %H:%M", "%d-%m-%Y %H:%M:%S"):
        try:
            return datetime.strptime(text, shape).strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0")
        except ValueError:
            continue
    return None


STANDARD = {
    "decimal": ["1e100000", "2.5E-100000", "١٢٣", "-٣,٥e٢", "1e+0007", "0e99999", "۱۲.۵0", "1e1234567890123456789", "12e", "𝟙𝟚"],
    "uuid": ["+" + "a" * 31, "0x" + "1" * 30, "1_2" + "3" * 29, "1__2" + "3" * 28, "_" + "1" * 31, "-" + "0" * 31, "-" + "1" * 31,
             "{urn:uuid:" + "0x_" + "f" * 29 + "}", "٣" * 32, "g" * 32, "0X" + "A" * 30, "{\t" + "b" * 30 + "}"],
    "datetime": ["٢٠٢٤-01-01 10:00", "2024-1٢-01 10:00", "2024-12-2٣ 1٠:3٠", "2024-01-01T٣:٤:٥", "2024-01-01 ٢٣:00", "01/02/٢٠٢٤ 9:5٩"],
}


@pytest.mark.parametrize("kind", sorted(STANDARD))
def test_as_the_standard_parsers(spark, kind):
    df = spark.createDataFrame(list(enumerate(STANDARD[kind])), "i INT, value STRING")
    got = [r.normalized for r in normalize_as(df, "value", kind).orderBy("i").collect()]
    assert got == [_standard(kind, v) for v in STANDARD[kind]]


def test_exponent_beyond_a_row_stays_a_decimal(spark):
    df = spark.createDataFrame([("1e999999999",), ("1e-99999999999999999",)], "value STRING")
    got = [r.s for r in suggest_normalizations(df, "value", "s").collect()]
    assert [(s.kind, s.normalized) for s in got] == [("decimal", None)] * 2
