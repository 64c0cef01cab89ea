"""The derived views and operators as plain SQL, written independently of the Spark code.

``CTES`` maps a name to SQL that may read driver tables and other names; ``query(sql)`` puts the needed ones in front.
"""

from __future__ import annotations

import re

from checks import views as V
from stmtgauge.functions.normalizers import HINTS

WS = "' \t\n\r\x0b\x0c'"


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def found(s: str, pattern: str, group: int) -> str:
    return f"CASE WHEN regexp_matches({s}, {q(pattern)}) THEN regexp_extract({s}, {q(pattern)}, {group}) END"


def quoted_split(s: str) -> str:
    """Comma split where quotes protect: all items with their separator, the empty one at the end left out."""
    items = f"regexp_extract_all({s}, {q(chr(40) + chr(40) + '?:[^' + chr(39) + ',]|' + chr(39) + '[^' + chr(39) + ']*(?:' + chr(39) + '|$))*)(,|$)')}, 1)"
    return f"list_transform({items}[1:len({items})-1], lambda x: trim(x, {WS}))"


def plain_split(s: str) -> str:
    return f"list_transform(string_split({s}, ','), lambda x: trim(x, {WS}))"


def names_split(s: str) -> str:
    return f"list_transform(string_split({s}, ','), lambda x: trim(x, ' []'))"


def unquoted(t: str) -> str:
    return f"CASE WHEN starts_with({t}, '''') AND ends_with({t}, '''') THEN substr({t}, 2, greatest(length({t}) - 2, 0)) ELSE {t} END"


def plain_name(t: str) -> str:
    return f"replace(replace({t}, '[', ''), ']', '')"


NAME = r"[\w.\[\]]+"
INS = rf"(?i)insert\s+into\s+({NAME})\s*\(([^)]+)\)"
INS_VALUES = rf"(?i)insert\s+into\s+({NAME})\s*\(([^)]+)\)\s*values\s*\(([^)]+)\)"
INS_TAIL = rf"(?is)insert\s+into\s+{NAME}\s*\([^)]+\)\s*values\s*(.+)$"
UPD = rf"(?is)update\s+({NAME})\s+set\s+(.+?)\s+where\s"
BULK = rf"(?i)bulk\s+insert\s+({NAME})\s+from\s+'([^']+)'"
MERGE = rf"(?i)merge\s+into\s+({NAME})"
MERGE_UPD = r"(?is)when\s+matched\s+then\s+update\s+set\s+(.+?)\s+(?:when|output|;|$)"
MERGE_INS = r"(?i)when\s+not\s+matched\s+then\s+insert\s*\(([^)]+)\)"
SEL = r"(?is)select\s+(.*?)\s+from\s"
FROM = rf"(?i)from\s+({NAME})"

# -- normalizers: a CASE per kind over cleaned text ------------------------------------------------------------------
# Country names with their ISO codes.
_COUNTRIES = {
    "sweden": "SE", "sverige": "SE", "united states": "US", "usa": "US", "united kingdom": "GB", "england": "GB",
    "germany": "DE", "deutschland": "DE", "norway": "NO", "norge": "NO", "denmark": "DK", "danmark": "DK",
    "finland": "FI", "suomi": "FI",
}
# Forms of date-times.
_FORMATS = (
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S.%f",
    "%Y-%m-%d %H:%M:%S.%f", "%d-%m-%Y %H:%M", "%d-%m-%Y %H:%M:%S",
)


def normalizer_columns(x: str) -> dict[str, str]:
    """kind -> SQL over the text expression ``x``, NULL when it does not apply. No exponents, ASCII text."""
    v = f"trim({x}, {WS})"
    packed = f"regexp_replace({x}, '\\s+', '', 'g')"
    dmy = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"
    part = lambda g: f"regexp_extract({v}, '{dmy}', {g})"
    date = (
        f"CASE WHEN regexp_matches({v}, '{dmy}') THEN concat(CASE WHEN length({part(3)}) = 4 THEN '' ELSE '20' END,"
        f" {part(3)}, '-', lpad({part(2)}, 2, '0'), '-', lpad({part(1)}, 2, '0'))"
        f" WHEN regexp_matches({v}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {v} END"
    )
    dashed = f"replace({v}, '/', '-')"
    loose = r"^[^ -]*-([^ -]-[^ -]*|[^ -]*-[^ -])( |$)"
    cut = f"CASE WHEN regexp_matches({dashed}, '{loose}') THEN array_to_string(string_split({dashed}, ' ')[1:2], ' ') ELSE {dashed} END"
    formats = ", ".join(q(f) for f in _FORMATS)
    moment = f"strftime(try_strptime({cut}, [{formats}]), '%Y-%m-%dT%H:%M:%S')"
    bare = f"replace({packed}, '(0)', '')"
    phone = (
        f"CASE WHEN starts_with({bare}, '0046') THEN concat('+', substr({bare}, 3))"
        f" WHEN starts_with({bare}, '00') THEN NULL WHEN starts_with({bare}, '0') THEN concat('+46', substr({bare}, 2))"
        f" WHEN starts_with({bare}, '+46') THEN {bare} END"
    )
    number = f"replace(replace({v}, ' ', ''), '_', '')"
    pointed = f"CASE WHEN contains({number}, '.') THEN {number} ELSE replace({number}, ',', '.') END"
    num = r"^([-+]?)0*(\d*)(?:(\.)(\d*))?$"
    npart = lambda g: f"regexp_extract({pointed}, '{num}', {g})"
    decimal = (
        f"CASE WHEN regexp_matches({pointed}, '^[-+]?(\\d+\\.?\\d*|\\.\\d+)$') THEN concat(replace({npart(1)}, '+', ''),"
        f" CASE WHEN {npart(2)} = '' THEN '0' ELSE {npart(2)} END,"
        f" CASE WHEN {npart(4)} = '' THEN '' ELSE concat('.', {npart(4)}) END) END"
    )
    hexes = f"replace(replace(replace(trim(lower({v}), '{{}}() '), 'urn:', ''), 'uuid:', ''), '-', '')"
    uuid = (
        f"CASE WHEN regexp_matches({hexes}, '^[0-9a-f]{{32}}$') THEN concat_ws('-', substr({hexes}, 1, 8),"
        f" substr({hexes}, 9, 4), substr({hexes}, 13, 4), substr({hexes}, 17, 4), substr({hexes}, 21, 12)) END"
    )
    names = " ".join(f"WHEN {q(k)} THEN {q(c)}" for k, c in _COUNTRIES.items())
    country = f"CASE WHEN regexp_matches({v}, '^\\p{{L}}{{2}}$') THEN upper({v}) ELSE CASE lower({v}) {names} END END"
    digits = f"regexp_replace({x}, '\\D+', '', 'g')"
    orgnr = (
        f"CASE WHEN length({digits}) = 10 THEN {digits} WHEN length({digits}) = 12 AND starts_with({digits}, '16')"
        f" THEN substr({digits}, 3) END"
    )
    return {
        "date": date,
        "datetime": moment,
        "phone": phone,
        "postal": f"CASE WHEN regexp_matches({packed}, '^[0-9]{{5}}$') THEN {packed} END",
        "email": f"CASE WHEN regexp_matches({v}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN lower({v}) END",
        "decimal": decimal,
        "uuid": uuid,
        "country_iso": country,
        "orgnr": orgnr,
    }


def suggested(source: str, x: str = "value") -> str:
    """SELECT *, kind, normalized, hint over a source."""
    columns = normalizer_columns(x)
    each = ", ".join(f"{sql} AS n_{kind}" for kind, sql in columns.items())
    kind = "CASE " + " ".join(f"WHEN n_{k} IS NOT NULL THEN '{k}'" for k in columns) + " END"
    first = "coalesce(" + ", ".join(f"n_{k}" for k in columns) + ")"
    hint = "CASE kind " + " ".join(f"WHEN '{k}' THEN {q(h)}" for k, h in HINTS.items()) + " END"
    skip = ", ".join(f"n_{k}" for k in columns)
    return (
        f"SELECT *, {hint} AS hint FROM (SELECT * EXCLUDE ({skip}), {kind} AS kind, {first} AS normalized"
        f" FROM (SELECT *, {each} FROM {source}))"
    )


def rule_values(rows: list) -> str:
    def row(r) -> str:
        envs = "NULL::VARCHAR[]" if r[8] is None else "[" + ", ".join(q(e) for e in r[8]) + "]::VARCHAR[]"
        return f"({r[0]}, {q(r[1])}, {q(r[2])}, {q(r[3])}, {q(r[4])}, {q(r[5])}, {r[6]}::DOUBLE, {r[7]}, {envs}, {r[9]})"

    names = "ord, id, target, selector, action, reason, confidence, enabled, envs, min_hits"
    return f"SELECT * FROM (VALUES {', '.join(row(r) for r in rows)}) AS t({names})"


def matched(source: str, table: str, column: str, text: str, keys: str = "evt", rules: str = "rules") -> str:
    """SELECT source columns, action, reason, confidence, rule_id: first enabled rule that matches. ``evt`` must be unique."""
    condition = f"""r.enabled AND (
        (r.target = 'table' AND e.{table} <> '' AND lower(r.selector) = lower(e.{table}))
        OR (r.target = 'column' AND e.{column} <> '' AND CASE WHEN contains(r.selector, '.')
            THEN lower(r.selector) = lower(e.{column})
            ELSE ltrim(lower(r.selector), '@') = ltrim(string_split(lower(e.{column}), '.')[-1], '@') END)
        OR (r.target = 'pattern' AND e.{text} <> '' AND contains(lower(e.{text}), lower(r.selector))))"""
    return f"""SELECT e.*, coalesce(r.action, 'allow') AS action, coalesce(r.reason, 'no matching rule') AS reason,
        coalesce(r.confidence, 1.0::DOUBLE) AS confidence, r.id AS rule_id
        FROM {source} AS e
        LEFT JOIN (SELECT e.{keys} AS k, min(r.ord) AS first FROM {source} AS e JOIN {rules} AS r ON {condition} GROUP BY 1) AS m
            ON m.k = e.{keys}
        LEFT JOIN {rules} AS r ON r.ord = m.first"""


_CELL_ROWS = f"""list_transform(regexp_extract_all(regexp_extract(sql_text, {q(INS_TAIL)}, 1), '\\(((?:[^()]|\\([^()]*\\))*)\\)', 1),
    lambda g: {quoted_split('g')})"""

CTES: dict[str, str] = {
    "query_log": V.QUERY_LOG.format(events="events"),
    "dirty_values": (
        "SELECT k, f.family AS family, f.value AS value FROM (SELECT c_custkey AS k, unnest(["
        + ", ".join(f"{{'family': '{n}', 'value': {e.format()}}}" for n, e in V.DIRTY_FAMILIES)
        + "]) AS f FROM customer)"
    ),
    "doc_values": f"SELECT doc_id, lang, source, unnest(regexp_extract_all(text, {q(V.TOKEN)})) AS value FROM documents",
    "rules": rule_values(V.RULES),
    "statements": f"SELECT *, trim(sql_text, {WS}) AS s FROM query_log WHERE sql_text IS NOT NULL",
    "shred": f"""SELECT *, {found('s', INS, 1)} AS i_table, CASE WHEN regexp_matches(s, {q(INS)})
            THEN {names_split(f"regexp_extract(s, {q(INS)}, 2)")} END AS i_cols,
        {found('s', UPD, 1)} AS u_table, CASE WHEN regexp_matches(s, {q(UPD)})
            THEN list_transform(string_split(regexp_extract(s, {q(UPD)}, 2), ','), lambda p: trim(split_part(p, '=', 1), ' []'))
            END AS u_cols,
        {found('s', INS_VALUES, 3)} AS i_vals, {found('s', INS_VALUES, 2)} AS iv_cols, {found('s', UPD, 2)} AS u_set
        FROM statements""",
    "profile_pairs": f"""SELECT seq, sql_text, coalesce(i_table, u_table) AS tbl, p[1] AS col, p[2] AS token FROM (
            SELECT *, unnest(list_transform(list_zip({names_split('iv_cols')}, {plain_split('i_vals')}, true),
                lambda z: [z[1], z[2]])) AS p FROM shred WHERE i_vals IS NOT NULL
            UNION ALL
            SELECT *, unnest(list_transform(list_filter(string_split(u_set, ','), lambda x: contains(x, '=')),
                lambda x: [trim(split_part(x, '=', 1), ' []'), trim(substr(x, strpos(x, '=') + 1), {WS})])) AS p
                FROM shred WHERE u_set IS NOT NULL)""",
    "profile_values": f"""SELECT seq, sql_text, tbl, col, concat(tbl, '.', col) AS field, {unquoted('token')} AS value,
        upper(token) = 'NULL' OR token IN ('', '''''') AS is_null FROM profile_pairs""",
    "profile_columns": """SELECT seq, i_table AS tbl, unnest(i_cols) AS col FROM shred WHERE i_table IS NOT NULL
        UNION ALL SELECT seq, u_table, unnest(u_cols) FROM shred WHERE u_table IS NOT NULL""",
    "value_tokens": f"""SELECT *, CASE WHEN i_vals IS NOT NULL THEN {quoted_split('i_vals')}
            WHEN u_set IS NOT NULL THEN list_transform(list_filter({quoted_split('u_set')}, lambda x: contains(x, '=')),
                lambda x: trim(substr(x, strpos(x, '=') + 1), {WS})) ELSE [] END AS tokens,
        coalesce(i_table, u_table) AS tbl, coalesce(i_cols, u_cols) AS cols,
        CASE WHEN regexp_matches(sql_text, {q(INS_TAIL)}) THEN {_CELL_ROWS} END AS many FROM shred""",
    "selects": f"""SELECT seq, {plain_name(f"regexp_extract(s, {q(FROM)}, 1)")} AS tbl, lst,
        CASE WHEN lst = '*' THEN [] ELSE {quoted_split('lst')} END AS expressions FROM (
            SELECT *, coalesce(trim({found('s', SEL, 1)}, {WS}), '*') AS lst FROM statements
            WHERE starts_with(lower(s), 'select ')) WHERE regexp_matches(s, {q(FROM)})""",
    # 200 characters after each name are searched for the first short quoted text.
    "rpc_params": r"""SELECT seq, ts, proc, row_number() OVER (PARTITION BY seq ORDER BY i) - 1 AS pos, name, value FROM (
        SELECT seq, ts, nullif(regexp_extract(sql_text, '([\w.\[\]]{3,})\s*@', 1), '') AS proc, i,
            regexp_extract(rest, '^[A-Za-z0-9_]{1,64}') AS name,
            regexp_extract(substr(rest, length(regexp_extract(rest, '^[A-Za-z0-9_]{1,64}')) + 1, 200), '''([^'']{0,120})''', 1) AS value,
            regexp_matches(substr(rest, length(regexp_extract(rest, '^[A-Za-z0-9_]{1,64}')) + 1, 200), '''[^'']{0,120}''') AS hit
        FROM (SELECT seq, ts, sql_text, i, array_to_string(string_split(sql_text, '@')[i:], '@') AS rest
            FROM query_log, range(2, 1 + greatest(len(string_split(coalesce(sql_text, ''), '@')), 1)) AS r(i)
            WHERE starts_with(sql_text, 'dbo.'))
        ) WHERE name <> '' AND hit""",
    "events_of_statements": "SELECT seq AS evt, seq, ts, sql_text, NULL::VARCHAR AS tbl, NULL::VARCHAR AS col FROM query_log WHERE sql_text <> ''",
    "statement_decisions": matched("events_of_statements", "tbl", "col", "sql_text"),
    "cells": f"""SELECT seq * 10000 + r * 100 + p AS evt, seq, ts, sql_text, tbl, r AS row_no, p AS pos,
            concat(tbl, '.', cols[p + 1]) AS col, {unquoted('cell_rows[r + 1][p + 1]')} AS value FROM (
        SELECT seq, ts, sql_text, tbl, cols, cell_rows, r, unnest(range(len(cell_rows[r + 1]))) AS p FROM (
            SELECT *, unnest(range(len(cell_rows))) AS r FROM (
                SELECT *, CASE WHEN len(many) > 0 AND len(list_filter(many, lambda m: len(m) <> len(cols))) = 0 THEN many
                    WHEN len(tokens) > 0 AND len(tokens) = len(cols) THEN [tokens] END AS cell_rows
                FROM value_tokens WHERE tbl IS NOT NULL) WHERE cell_rows IS NOT NULL))""",
    "cell_decisions": matched("cells", "tbl", "col", "sql_text"),
    "cell_corrections": f"""SELECT * FROM ({suggested("(SELECT * FROM cell_decisions WHERE action = 'autocorrect')")})
        WHERE normalized <> value""",
    "events_of_params": "SELECT seq * 100 + pos AS evt, *, NULL::VARCHAR AS sql_text, NULL::VARCHAR AS tbl FROM rpc_params",
    "param_decisions": matched("events_of_params", "tbl", "name", "sql_text"),
    "decisions": """SELECT seq, 0 AS step, 0 AS row_no, 0 AS pos, ts, action, rule_id, reason, confidence, left(sql_text, 200) AS sample,
            NULL AS before FROM statement_decisions
        UNION ALL SELECT seq, 1, row_no, pos, ts, action, rule_id, reason, NULL, NULL, value FROM cell_corrections
        UNION ALL SELECT seq, 2, 0, pos, ts, action, rule_id, reason, NULL, NULL, NULL FROM param_decisions""",
    "facts": f"""SELECT concat(tbl, '.', col) AS field, 1 AS written, false AS is_null, NULL AS kind, client_app FROM profile_columns
            JOIN (SELECT seq AS s2, client_app FROM query_log) ON s2 = seq
        UNION ALL SELECT field, 0, is_null, kind, client_app FROM ({suggested('profile_values')})
            JOIN (SELECT seq AS s2, client_app FROM query_log) ON s2 = seq""",
    "profiles": """SELECT field, sum(written)::BIGINT AS n_writes, count_if(is_null)::BIGINT AS n_nulls, count(kind) AS n_suggestions
        FROM facts WHERE written = 1 OR kind IS NOT NULL OR is_null GROUP BY field""",
    "profile_kinds": "SELECT field, kind, count(*) AS n FROM facts WHERE kind IS NOT NULL GROUP BY field, kind",
    "profiles_prev": """SELECT field, sum(written)::BIGINT AS n_writes, count_if(is_null)::BIGINT AS n_nulls FROM facts
        WHERE client_app IN ('click', 'view') AND (written = 1 OR kind IS NOT NULL OR is_null) GROUP BY field""",
    "profiles_curr": """SELECT field, sum(written)::BIGINT AS n_writes, count_if(is_null)::BIGINT AS n_nulls FROM facts
        WHERE client_app NOT IN ('click', 'view') AND (written = 1 OR kind IS NOT NULL OR is_null) GROUP BY field""",
    "policy_events": "SELECT row_number() OVER (ORDER BY seq, field, value) AS evt, seq, sql_text, tbl, field AS col, value FROM profile_values",
    "policy_decided": matched("policy_events", "tbl", "col", "sql_text"),
    "rule_table": V.RULE_TABLE.format(part="part"),
    "raw_rules": V.RAW_RULES.format(part="part"),
    "rules_before": V.RULES_BEFORE.format(part="part"),
    "rules_after": V.RULES_AFTER.format(part="part"),
    "requests": V.REQUESTS.format(conversations="conversations"),
    "increments": """SELECT concat('rule:', rule_id, ':', action) AS key FROM decisions WHERE rule_id IS NOT NULL AND step <> 2
        UNION ALL SELECT 'autocorrect_suggested' FROM decisions WHERE step = 1""",
}


def query(sql: str) -> str:
    """Put the named views that ``sql`` reads, and those they read, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + sql
