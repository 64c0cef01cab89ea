"""Column expressions that read facts from the text of one statement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtgauge.functions.text import (
    extract,
    extract_any,
    is_quoted,
    let,
    plain_name,
    split_commas,
    split_commas_outside_quotes,
    strip,
    strip_name,
    unquote,
)

# The statement shapes recognised. Unicode word and space classes, any letter case; in the shapes with
# a lazy part the dot also takes line breaks.
_NAME = r"[\w.\[\]]+"
INSERT_COLUMNS = rf"(?iU)insert\s+into\s+({_NAME})\s*\(([^)]+)\)"
INSERT_VALUES = rf"(?iU)insert\s+into\s+{_NAME}\s*\(([^)]+)\)\s*values\s*\(([^)]+)\)"
INSERT_ROWS = rf"(?isU)insert\s+into\s+{_NAME}\s*\([^)]+\)\s*values\s*(.+)"
UPDATE_SET = rf"(?isU)update\s+({_NAME})\s+set\s+(.+?)\s+where\s"
BULK_LOAD = rf"(?iU)bulk\s+insert\s+({_NAME})\s+from\s+'([^']+)'"
MERGE_TARGET = rf"(?iU)merge\s+into\s+({_NAME})"
MERGE_UPDATE = r"(?isU)when\s+matched\s+then\s+update\s+set\s+(.+?)\s+(?:when|output|;|\z)"
MERGE_INSERT = r"(?iU)when\s+not\s+matched\s+then\s+insert\s*\(([^)]+)\)"
SELECT_LIST = r"(?isU)select\s+(.*?)\s+from\s"
FROM_TABLE = rf"(?iU)from\s+({_NAME})"
RPC_PROC = r"(?U)([\w.\[\]]{3,})\s*@"
# A parameter name, and the 200 characters after it in which its value is looked for.
RPC_PARAM = r"(?s)@([A-Za-z0-9_]{1,64})(?=(.{0,200}))"
RPC_VALUE = r"'([^']{0,120})'"
NUMBER = r"(?U)^-?\d+(?:\.\d+)?\n?\z"


def _no_texts() -> Column:
    return F.array().cast("array<string>")


# -- written tables and columns ------------------------------------------------------------------------------------
def insert_table(sql: Column) -> Column:
    return extract(sql, INSERT_COLUMNS, 1)


def update_table(sql: Column) -> Column:
    return extract(sql, UPDATE_SET, 1)


def insert_columns(sql: Column) -> Column:
    """Column names of an INSERT, NULL when there is none."""
    names = F.transform(F.split(extract(sql, INSERT_COLUMNS, 2), ","), strip_name)
    return names


def update_columns(sql: Column) -> Column:
    """Left-hand sides of an UPDATE ... SET, NULL when there is none."""
    names = F.transform(
        F.split(extract(sql, UPDATE_SET, 2), ","), lambda part: strip_name(F.split_part(part, F.lit("="), F.lit(1)))
    )
    return names


def written_table(sql: Column) -> Column:
    return F.coalesce(insert_table(sql), update_table(sql))


def written_columns(sql: Column) -> Column:
    """Columns of the INSERT, else of the UPDATE, else an empty array."""
    return F.coalesce(insert_columns(sql), update_columns(sql), _no_texts())


# -- written values ------------------------------------------------------------------------------------------------
def _assignment(part: Column) -> tuple[Column, Column]:
    """Both sides of ``column = value`` (only the first sign counts)."""
    at = F.instr(part, "=")
    return F.left(part, at - 1), F.substr(part, at + 1)


def insert_tokens(sql: Column) -> Column:
    """Raw tokens of the first VALUES list, quotes kept; the list ends at the first closing parenthesis."""
    return split_commas_outside_quotes(extract(sql, INSERT_VALUES, 2))


def update_tokens(sql: Column) -> Column:
    parts = split_commas_outside_quotes(extract(sql, UPDATE_SET, 2))
    values = F.transform(
        F.filter(parts, lambda part: F.contains(part, F.lit("="))), lambda part: strip(_assignment(part)[1])
    )
    return values


def written_tokens(sql: Column) -> Column:
    """Raw value tokens of the INSERT, else of the UPDATE, else an empty array."""
    return F.coalesce(insert_tokens(sql), update_tokens(sql), _no_texts())


def plain_pairs(sql: Column) -> Column:
    """(column, token) pairs by a plain comma split, INSERT pairs first, then UPDATE pairs.

    Columns and values are zipped up to the shorter list; tokens keep their quotes.
    """
    pair = lambda c, t: F.struct(c.alias("column"), t.alias("token"))
    none = F.array().cast("array<struct<column:string,token:string>>")
    names = F.transform(F.split(extract(sql, INSERT_VALUES, 1), ","), strip_name)
    tokens = split_commas(extract(sql, INSERT_VALUES, 2))
    inserted = F.filter(
        F.zip_with(names, tokens, pair), lambda p: p["column"].isNotNull() & p["token"].isNotNull()
    )
    parts = F.filter(F.split(extract(sql, UPDATE_SET, 2), ","), lambda p: F.contains(p, F.lit("=")))
    updated = F.transform(parts, lambda p: pair(strip_name(_assignment(p)[0]), strip(_assignment(p)[1])))
    return F.concat(F.coalesce(inserted, none), F.coalesce(updated, none))


def token_is_null(token: Column) -> Column:
    """A bare NULL or an empty literal."""
    return (F.upper(token) == "NULL") | (unquote(token) == "")


# -- multi-row VALUES ----------------------------------------------------------------------------------------------
def value_groups(text: Column) -> Column:
    """Texts of the outermost parenthesised groups; quotes do not protect parentheses.

    Without nesting and without a stray closing parenthesis a regex finds them. Otherwise the text is folded piece by
    piece with a depth counter, to any depth.
    """
    return let(text, _groups)


def _groups(tail: Column) -> Column:
    flat = F.regexp_extract_all(tail, F.lit(r"\(([^()]*)\)"), F.lit(1))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("text"), _no_texts().alias("groups")
    )

    def step(state: Column, piece: Column) -> Column:
        depth, text, groups = state["depth"], state["text"], state["groups"]
        opens, closes = piece == "(", piece == ")"
        after = depth + F.when(opens, F.lit(1)).when(closes, F.lit(-1)).otherwise(F.lit(0))
        begins, ends = opens & (after == 1), closes & (after == 0)
        return F.struct(
            after.alias("depth"),
            F.when(begins | ends, F.lit("")).when(after >= 1, F.concat(text, piece)).otherwise(text).alias("text"),
            F.when(ends, F.concat(groups, F.array(text))).otherwise(groups).alias("groups"),
        )

    pieces = F.regexp_extract_all(tail, F.lit(r"[()]|[^()]+"), F.lit(0))
    nested = F.aggregate(pieces, start, step, lambda state: state["groups"])
    irregular = tail.rlike(r"\([^()]*\(|(?:^|\))[^()]*\)")
    return F.when(irregular, nested).otherwise(flat)


def multirow_tokens(sql: Column) -> Column:
    """Rows of raw tokens of INSERT ... VALUES (..),(..), NULL when there is no group."""
    groups = F.filter(F.array(value_groups(extract(sql, INSERT_ROWS, 1))), lambda g: F.size(g) > 0)
    return F.transform(F.get(groups, F.lit(0)), split_commas_outside_quotes)


# -- bulk load, merge, select --------------------------------------------------------------------------------------
def merge_updated(sql: Column) -> Column:
    parts = split_commas_outside_quotes(F.regexp_extract(sql, MERGE_UPDATE, 1))
    names = F.transform(
        parts,
        lambda p: strip_name(F.regexp_replace(strip(F.split_part(p, F.lit("="), F.lit(1))), r"(?U)^\w+\.", "")),
    )
    return F.when(
        sql.rlike(MERGE_TARGET) & sql.rlike(MERGE_UPDATE), F.filter(names, lambda n: n != "")
    ).otherwise(_no_texts())


def merge_inserted(sql: Column) -> Column:
    names = F.transform(F.split(F.regexp_extract(sql, MERGE_INSERT, 1), ","), strip_name)
    return F.when(
        sql.rlike(MERGE_TARGET) & sql.rlike(MERGE_INSERT), F.filter(names, lambda n: n != "")
    ).otherwise(_no_texts())


def select_table(sql: Column) -> Column:
    return plain_name(extract(sql, FROM_TABLE, 1))


def select_list(sql: Column) -> Column:
    """Text of the select list; no match counts as ``*``."""
    return F.coalesce(strip(extract_any(sql, SELECT_LIST, 1)), F.lit("*"))


def select_expressions(select_text: Column) -> Column:
    return F.when(select_text == "*", _no_texts()).otherwise(split_commas_outside_quotes(select_text))


# -- rewriting -----------------------------------------------------------------------------------------------------
def literal(value: Column) -> Column:
    """A value as SQL text: numbers bare, everything else quoted, quotes doubled."""
    text = F.coalesce(value, F.lit(""))
    return F.when(text.rlike(NUMBER), text).otherwise(
        F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    )


def rewritten_token(token: Column, value: Column, compat: bool = False) -> Column:
    """Text for a token whose value may have been corrected to ``value`` (NULL: unchanged).

    ``compat`` re-encodes every value, which quotes a bare NULL and doubles quotes once more.
    """
    current = F.coalesce(value, unquote(token))
    if compat:
        return literal(current)
    undoubled = F.when(is_quoted(token), F.replace(current, F.lit("''"), F.lit("'"))).otherwise(current)
    bare_null = value.isNull() & (F.upper(token) == "NULL")
    return F.when(bare_null, token).otherwise(literal(F.coalesce(value, undoubled)))


# Frames of statements around what is replaced.
_INSERT_FRAME = rf"(?isU)(insert\s+into\s+{_NAME}\s*\([^)]+\)\s*values\s*\()([^)]+)(\).*)"
_ROWS_FRAME = rf"(?isU)(insert\s+into\s+{_NAME}\s*\([^)]+\)\s*values\s*).+"
_UPDATE_FRAME = rf"(?isU)(update\s+{_NAME}\s+set\s+)(.+?)(\s+where\s.+)"


def rebuilt_insert(sql: Column, literals: Column) -> Column:
    """INSERT with its first VALUES list replaced; NULL when the statement is no such INSERT."""
    frame = lambda g: F.regexp_extract(sql, _INSERT_FRAME, g)
    # The first group is never empty where the frame matches.
    return let(frame(1), lambda head: F.when(head != "", F.concat(head, F.array_join(literals, ", "), frame(3))))


def rebuilt_update(sql: Column, columns: Column, literals: Column) -> Column:
    """UPDATE with its SET list replaced, ``column = value``."""
    frame = lambda g: F.regexp_extract(sql, _UPDATE_FRAME, g)
    pairs = F.zip_with(columns, literals, lambda c, v: F.concat(c, F.lit(" = "), v))
    pairs = F.filter(pairs, lambda p: p.isNotNull())
    return let(frame(1), lambda head: F.when(head != "", F.concat(head, F.array_join(pairs, ", "), frame(3))))


def rebuilt_rows(sql: Column, rows: Column) -> Column:
    """INSERT with all its rows replaced; text behind the rows is not kept."""
    texts = F.transform(rows, lambda row: F.concat(F.lit("("), F.array_join(row, ", "), F.lit(")")))
    return let(F.regexp_extract(sql, _ROWS_FRAME, 1), lambda head: F.when(head != "", F.concat(head, F.array_join(texts, ", "))))


# -- remote procedure calls ----------------------------------------------------------------------------------------
def rpc_procedure(text: Column) -> Column:
    return extract(text, RPC_PROC, 1)


def rpc_params(text: Column) -> Column:
    """(name, value): after each ``@name`` the first short quoted text within the next 200 characters."""
    names = F.regexp_extract_all(text, F.lit(RPC_PARAM), F.lit(1))
    windows = F.regexp_extract_all(text, F.lit(RPC_PARAM), F.lit(2))
    pairs = F.zip_with(
        names, windows, lambda n, w: F.struct(n.alias("name"), extract_any(w, RPC_VALUE, 1).alias("value"))
    )
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def has_keyword(text: Column) -> Column:
    """Cheap filter for text that may hold a statement."""
    low = F.lower(text)
    hits = [F.contains(low, F.lit(word)) for word in ("insert ", "update ", "delete ", "select ")]
    return hits[0] | hits[1] | hits[2] | hits[3]


def is_select(text: Column) -> Column:
    return F.lower(strip(text)).startswith("select ")

