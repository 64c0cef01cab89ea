"""Value normalizers as Column expressions.

Each rule is a pair *applies* / *normalized* so that a caller can test once and render once. All of them work on shared
cleaned forms of the value (:func:`cleaned_forms`), which the DataFrame functions put into one projection.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtgauge.functions.text import no_space, strip

# Advice shown for each kind of normalization.
HINTS = {
    "date": "Use ISO dates (YYYY-MM-DD)",
    "phone": "Include country code (e.g., +46)",
    "postal": "Use 5 digits without spaces",
    "email": "Provide a valid email (local@domain)",
    "country_iso": "Use ISO 3166-1 alpha-2 (e.g., SE)",
    "orgnr": "Use normalized organisation number format",
    "decimal": "Use dot as decimal separator (e.g., 1234.56)",
    "uuid": "Use canonical UUID (8-4-4-4-12, lowercase)",
    "datetime": "Use ISO 8601 (YYYY-MM-DDTHH:MM:SS)",
}

# Country names with their ISO codes (two-letter names never get here, they are taken as codes).
COUNTRY_CODES = {
    "sweden": "SE", "sverige": "SE",
    "united states": "US", "usa": "US", "us": "US",
    "united kingdom": "GB", "uk": "GB", "england": "GB",
    "germany": "DE", "deutschland": "DE",
    "norway": "NO", "norge": "NO",
    "denmark": "DK", "danmark": "DK",
    "finland": "FI", "suomi": "FI",
}

# Order in which the kinds are tried.
SUGGESTION_ORDER = (
    "date", "datetime", "phone", "postal", "email", "decimal", "uuid", "country_iso", "orgnr",
)

#: Longest plain notation of a decimal with an exponent. A longer one is still a decimal, but its text is NULL: it would
#: not fit into a row.
MAX_PLAIN_CHARS = 10_000_000
# The standard parser knows exponents up to this many digits.
_EXPONENT_DIGITS = 18

#: Every decimal digit of Unicode and the ASCII digits they stand for, in the same order.
_DIGITS = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd")
_AS_ASCII = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


class Forms(NamedTuple):
    """Cleaned forms of a value, computed once per value and shared by the rules."""

    raw: Column
    stripped: Column
    packed: Column
    lowered: Column
    number: Column
    moment: Column
    hex_text: Column


class Rule(NamedTuple):
    applies: Callable[[Forms], Column]
    normalized: Callable[[Forms], Column]


FORM_NAMES = Forms._fields[1:]


def _ascii_digits(text: Column) -> Column:
    """Digits of any script as ASCII digits."""
    return F.when(text.rlike(r"(?U)[^\x00-\x7F&&[\d]]"), F.translate(text, _DIGITS, _AS_ASCII)).otherwise(text)


def cleaned_forms(raw: Column) -> list[dict[str, Column]]:
    """The forms as consecutive projections: each uses columns ``__<form>`` of the projections before it."""
    stripped, lowered, dashed = F.col("__stripped"), F.col("__lowered"), F.col("__moment")
    number = _ascii_digits(F.translate(stripped, " _", ""))
    return [
        {"__stripped": strip(raw), "__packed": no_space(raw)},
        {
            "__lowered": F.lower(stripped),
            "__number": F.when(F.contains(number, F.lit(".")), number).otherwise(F.translate(number, ",", ".")),
            "__moment": F.when(stripped.rlike(_MAYBE_MOMENT), _dashed(stripped)),
        },
        {"__hex_text": _hex_text(lowered), "__moment": F.when(dashed.rlike(_MOMENT), _moment(dashed))},
    ]


def shared_forms(raw: Column) -> Forms:
    return Forms(raw, *[F.col("__" + name) for name in FORM_NAMES])


# -- dates ---------------------------------------------------------------------------------------------------------
_YMD = r"(?U)^\d{4}-\d{2}-\d{2}\z"
_DATE = r"(?U)^(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\z"


def _date(f: Forms) -> Column:
    # Always day, month, year; years of two or three digits get the prefix 20; the calendar is not consulted.
    parts = F.split(f.stripped, "[/-]")
    year = F.get(parts, F.lit(2))
    return F.when(f.stripped.rlike(_YMD), f.stripped).otherwise(
        F.concat_ws(
            "-",
            F.when(F.length(year) == 4, year).otherwise(F.concat(F.lit("20"), year)),
            F.lpad(F.get(parts, F.lit(1)), 2, "0"),
            F.lpad(F.get(parts, F.lit(0)), 2, "0"),
        )
    )


# -- date and time -------------------------------------------------------------------------------------------------
# Cheap first test: digits, two dashes or slashes and a colon must be there.
_MAYBE_MOMENT = r"(?sU)\d.*[-/].*[-/].*:"
_MONTH = "(1[0-2]|0?[1-9])"
# A blank may stand for the leading zero of a day.
_DAY = r"(?:[ ](?=[1-9](?!\d)))?(3[01]|[12]\d|0?[1-9])"
# Digits of any script are accepted where the standard parser accepts them: years, second digits, single digits.
_TIME = r"(2[0-3]|[01]\d|\d):([0-5]\d|\d)(?::([0-5]\d|\d)"
_YMD_TIME = rf"(\d{{4}})-{_MONTH}-{_DAY}(?:[Tt]|\s+){_TIME}(?:\.[0-9]{{1,6}})?)?"
_DMY_TIME = rf"{_DAY}-{_MONTH}-(\d{{4}})\s+{_TIME})?"
_MOMENT = rf"(?U)^(?:{_YMD_TIME}|{_DMY_TIME})\z"
_ONE_DIGIT_DATE = r"(?s)^([^- ]*-(?:[^- ]-[^- ]*|[^- ]*-[^- ])(?: [^ ]*)?)(?: .*)?\z"


def _dashed(stripped: Column) -> Column:
    """Slashes become dashes. A one-digit month or day also cuts everything after the second space-separated part."""
    return F.regexp_replace(F.translate(stripped, "/", "-"), _ONE_DIGIT_DATE, "$1")


def _moment(dashed: Column) -> Column:
    """ISO text: put two zeros before every part, then keep the last two digits of each."""
    widened = F.regexp_replace(dashed, rf"(?U)^{_YMD_TIME}\z", "$1-00$2-00$3T00$4:00$5:00$6")
    widened = F.regexp_replace(widened, rf"(?U)^{_DMY_TIME}\z", "$3-00$2-00$1T00$4:00$5:00$6")
    return F.regexp_replace(_ascii_digits(widened), r"([-T:])0*([0-9]{2})(?![0-9])", "$1$2")


def _is_moment(f: Forms) -> Column:
    # The text already has the right shape; the date itself must exist.
    return F.left(f.moment, F.lit(10)).try_cast("date").isNotNull() & ~f.moment.startswith("0000")


# -- phone, email --------------------------------------------------------------------------------------------------
def _phone_text(f: Forms) -> Column:
    return F.replace(f.packed, F.lit("(0)"), F.lit(""))


def _phone(f: Forms) -> Column:
    # 00.. is an international prefix, any other leading 0 a national one.
    return F.regexp_replace(F.regexp_replace(_phone_text(f), "^00", "+"), "^0", "+46")


_PHONE = r"^(?:\+46|0046|0(?!0))"
_EMAIL = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+\z"


# -- decimals ------------------------------------------------------------------------------------------------------
_FINITE = rf"([-+]?)(?=[0-9]|\.[0-9])([0-9]*)(?:\.([0-9]*))?(?:[eE]([-+]?)0*([0-9]{{1,{_EXPONENT_DIGITS}}}))?"
_NOT_FINITE = r"[-+]?(?i:inf(?:inity)?|s?nan[0-9]*)"
_DECIMAL = rf"^(?:{_FINITE}|{_NOT_FINITE})\z"


def _decimal(f: Forms) -> Column:
    """Plain notation by string algebra, since the precision is unbounded."""
    n = f.number
    unsigned = F.regexp_replace(n, "^[-+]", "")
    sign = F.when(n.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    # 0 in front, needless zeros away, no bare point at the end.
    plain = F.regexp_replace(F.regexp_replace(F.concat(F.lit("0"), unsigned), "^0+(?=[0-9])", ""), r"\.\z", "")
    special = F.when(F.lower(unsigned).startswith("inf"), F.lit("Infinity")).otherwise(
        F.regexp_replace(F.lower(unsigned), "^(s?)nan0*", "$1NaN")
    )
    text = (
        F.when(n.rlike("[nN]"), special)
        .when(n.rlike("[eE]"), _shifted(n))
        .otherwise(plain)
    )
    return F.concat(sign, text)


def _shifted(number: Column) -> Column:
    """Scientific notation, unsigned: all digits with the point moved by the exponent."""
    part = lambda g: F.regexp_extract(number, rf"^{_FINITE}\z", g)
    digits = F.concat(part(2), part(3))
    wide = F.concat(part(4), part(5)).cast("bigint") - F.length(part(3))
    fits = F.abs(wide) + F.length(digits) <= MAX_PLAIN_CHARS
    shift = F.when(fits, wide).cast("int")
    # A let-binding: this rare branch would otherwise repeat the regexes many times.
    return F.get(
        F.transform(F.array(F.struct(digits.alias("d"), shift.alias("s"))), lambda x: _move_point(x["d"], x["s"])),
        F.lit(0),
    )


def _move_point(d: Column, shift: Column) -> Column:
    trimmed = lambda c: F.regexp_replace(c, "^0+(?=[0-9])", "")
    zero = d.rlike(r"^0*\z")
    whole = F.when(zero & shift.isNotNull(), F.lit("0")).otherwise(trimmed(F.concat(d, F.repeat(F.lit("0"), shift))))
    left = F.left(F.lpad(d, F.greatest(F.length(d), 1 - shift), F.lit("0")), F.greatest(F.length(d) + shift, F.lit(1)))
    right = F.right(F.lpad(d, F.greatest(F.length(d), -shift), F.lit("0")), -shift)
    return F.when(shift >= 0, whole).otherwise(F.concat(trimmed(left), F.lit("."), right))


# -- uuid, country, organisation number ----------------------------------------------------------------------------
def _hex_text(lowered: Column) -> Column:
    inner = F.btrim(lowered, F.lit("{}() "))
    named = F.replace(F.replace(inner, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    return _ascii_digits(F.translate(F.btrim(named, F.lit("{}")), "-", ""))


# What the standard parser takes for a whole number of base 16: blanks around, a sign, 0x, single underscores between digits.
_HEX_NUMBER = r"(?U)^\s*(?:\+?(?:0x_?)?[0-9a-f](?:_?[0-9a-f])*|-(?:0x_?)?0(?:_?0)*)\s*\z"


def _is_uuid(f: Forms) -> Column:
    return (F.length(f.hex_text) == 32) & f.hex_text.rlike(_HEX_NUMBER)


def _uuid(f: Forms) -> Column:
    digits = F.lpad(F.regexp_replace(f.hex_text, r"(?U)^\s*[-+]?(?:0x)?|[_\s]", ""), 32, "0")
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def _is_country(f: Forms) -> Column:
    return f.stripped.rlike(r"^\p{L}{2}\z") | f.lowered.isin(*COUNTRY_CODES)


def _country(f: Forms) -> Column:
    names = F.create_map(*[F.lit(x) for pair in COUNTRY_CODES.items() for x in pair])
    return F.when(F.length(f.stripped) == 2, F.upper(f.stripped)).otherwise(F.try_element_at(names, f.lowered))


def _digits(f: Forms) -> Column:
    return F.regexp_replace(f.raw, r"(?U)\D+", "")


RULES: dict[str, Rule] = {
    "date": Rule(lambda f: f.stripped.rlike(_DATE), _date),
    "datetime": Rule(_is_moment, lambda f: f.moment),
    "phone": Rule(lambda f: _phone_text(f).rlike(_PHONE), _phone),
    "postal": Rule(lambda f: f.packed.rlike("^[0-9]{5}\\z"), lambda f: f.packed),
    "email": Rule(lambda f: f.stripped.rlike(_EMAIL), lambda f: f.lowered),
    "decimal": Rule(lambda f: f.number.rlike(_DECIMAL), _decimal),
    "uuid": Rule(_is_uuid, _uuid),
    "country_iso": Rule(_is_country, _country),
    "orgnr": Rule(lambda f: _digits(f).rlike("(?U)^(?:16)?\\d{10}\\z"), lambda f: F.right(_digits(f), F.lit(10))),
}


def normalized(kind: str, forms: Forms) -> Column:
    """Normalized text of one kind, NULL where the value is not of that kind."""
    rule = RULES[kind]
    return F.when(rule.applies(forms), rule.normalized(forms))


def hint_of(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair]), kind)


def first_kind(forms: Forms) -> Column:
    """Name of the first kind in the fixed order that applies, NULL when none does."""
    kinds = [F.when(RULES[k].applies(forms), F.lit(k)) for k in SUGGESTION_ORDER]
    return F.coalesce(*kinds)


def normalized_as(kind: Column, forms: Forms) -> Column:
    """Render the value according to a kind found by :func:`first_kind`."""
    branches = F.when(F.lit(False), F.lit(None).cast("string"))
    for k in SUGGESTION_ORDER:
        branches = branches.when(kind == k, RULES[k].normalized(forms))
    return branches
