"""Small string Column builders shared by the shredders and normalizers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space (Unicode definition plus the four ASCII separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)

_ASCII_WHITESPACE = "".join(c for c in WHITESPACE if ord(c) < 128)

# One piece of a comma list: runs without quote or comma, and quoted runs, then a comma or the end. Possessive, so the
# matcher neither backtracks nor recurs on long texts.
_PIECE = r"((?:[^',]++|'[^']*+(?:'|\z))*+)(?:,|\z)"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` alone removes spaces only)."""
    # The long list is slow to search, and of no use for a text of ASCII characters only.
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.btrim(c, F.lit(_ASCII_WHITESPACE))).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def no_space(c: Column) -> Column:
    """Remove every white-space character."""
    return F.translate(c, WHITESPACE, "")


def strip_name(c: Column) -> Column:
    """Remove spaces and square brackets from both ends of an identifier; tabs and newlines stay."""
    return F.btrim(c, F.lit(" []"))


def plain_name(c: Column) -> Column:
    """``[dbo].[T]`` to ``dbo.T``."""
    return F.translate(c, "[]", "")


def is_quoted(c: Column) -> Column:
    return c.startswith("'") & c.endswith("'")


def unquote(c: Column) -> Column:
    """Drop one pair of surrounding single quotes."""
    return F.when(is_quoted(c), F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))).otherwise(c)


def nonempty(c: Column) -> Column:
    """NULL for the empty string: both mean 'absent' to the matchers."""
    return F.nullif(c, F.lit(""))


def extract(c: Column, pattern: str, group: int) -> Column:
    """Regex group or NULL when the pattern does not match, for groups that are never empty when it does."""
    return let(F.regexp_extract(c, pattern, group), nonempty)


def extract_any(c: Column, pattern: str, group: int) -> Column:
    """As :func:`extract` for groups that may be empty, at the price of a second run of the regex."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def split_commas(c: Column) -> Column:
    """Plain comma split, pieces stripped of white space."""
    return F.transform(F.split(c, ","), strip)


def split_commas_outside_quotes(c: Column) -> Column:
    """Comma split in which a single quote toggles 'inside'.

    A last piece without any character is dropped, other pieces are stripped.
    """
    # The search finds one more, empty piece at the end of every text.
    found = F.regexp_extract_all(c, F.lit(_PIECE), F.lit(1))
    return let(found, lambda pieces: F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), strip))


def utf16_units(c: Column) -> Column:
    """UTF-16 code units of a string (a supplementary character counts two)."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")
