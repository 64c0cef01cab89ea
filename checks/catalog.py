"""The registered queries: for each operator a Spark query over the driver tables and, where SQL can say it, the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import duck as K
from checks import streams
from checks import views as V
from checks.registry import QUERIES, SQL, big, register
from stmtgauge.functions import binary as B
from stmtgauge.functions import statements as S
from stmtgauge.functions.text import plain_name, strip
from stmtgauge.operators import correct, metrics, normalize, packets, policy, profiles, rpc, shred
from stmtgauge.operators import decisions as D
from stmtgauge.plans import reports
from stmtgauge.sources.storage import fresh_folder, materialize
from stmtgauge.streaming import jobs, stateful

ORDER = correct.LOG_ORDER
DAY = "2024-01-10"


# -- value normalization ---------------------------------------------------------------------------------------------
def _register_kind(kind: str) -> None:
    expr = K.normalizer_columns("value")[kind]
    sql = f"SELECT k, family, value, normalized FROM (SELECT k, family, value, {expr} AS normalized FROM dirty_values)"

    @register(f"normalize_{kind}", sql)
    def _(spark, sf_dir):
        return normalize.normalize_as(V.dirty_values(spark, sf_dir), "value", kind)


for _kind in ("date", "datetime", "phone", "postal", "email", "decimal", "uuid", "country_iso", "orgnr"):
    _register_kind(_kind)


@register(
    "suggest_normalizations",
    f"SELECT k, family, value, kind, normalized, hint FROM ({K.suggested('dirty_values')})",
)
def _(spark, sf_dir):
    found = normalize.suggest_normalizations(V.dirty_values(spark, sf_dir), "value")
    return found.select("k", "family", "value", "suggestion.kind", "suggestion.normalized", "suggestion.hint")


@register(
    "suggest_for_documents",
    f"""SELECT source, lang, kind, count(*) AS n, min(normalized) AS first_value, max(normalized) AS last_value
        FROM ({K.suggested('doc_values')}) GROUP BY source, lang, kind""",
)
def _(spark, sf_dir):
    found = normalize.suggest_normalizations(V.doc_values(spark, sf_dir), "value")
    return found.groupBy("source", "lang", F.col("suggestion.kind").alias("kind")).agg(
        F.count("*").alias("n"),
        F.min("suggestion.normalized").alias("first_value"),
        F.max("suggestion.normalized").alias("last_value"),
    )


@register(
    "clean_columns",
    f"""SELECT k, coalesce({K.normalizer_columns('phone')['phone']}, phone) AS phone, coalesce(normalized, value) AS value
        FROM ({K.suggested("(SELECT k, concat('070-', CAST(k AS VARCHAR)) AS phone, value FROM dirty_values)")})""",
)
def _(spark, sf_dir):
    df = V.dirty_values(spark, sf_dir).select("k", F.concat(F.lit("070-"), "k").alias("phone"), "value")
    return normalize.normalize_columns(df, {"phone": "phone", "value": "auto"})


# -- statement shredding ---------------------------------------------------------------------------------------------
@register(
    "written_columns",
    """SELECT seq, coalesce(i_table, u_table) AS table_name, unnest(range(len(coalesce(i_cols, u_cols)))) AS pos,
        unnest(coalesce(i_cols, u_cols)) AS column_name FROM shred WHERE coalesce(i_table, u_table) IS NOT NULL""",
)
def _(spark, sf_dir):
    found = shred.written_columns(V.query_log(spark, sf_dir))
    return found.select("seq", F.col("table").alias("table_name"), big("pos"), F.col("column").alias("column_name"))


@register("profiled_columns", "SELECT seq, tbl AS table_name, col AS column_name FROM profile_columns")
def _(spark, sf_dir):
    found = shred.profiled_columns(V.query_log(spark, sf_dir))
    return found.select("seq", F.col("table").alias("table_name"), F.col("column").alias("column_name"))


@register(
    "profiled_values",
    "SELECT seq, tbl AS table_name, col AS column_name, value, is_null FROM profile_values",
)
def _(spark, sf_dir):
    found = shred.profiled_values(V.query_log(spark, sf_dir))
    return found.select("seq", F.col("table").alias("table_name"), F.col("column").alias("column_name"), "value", "is_null")


@register(
    "split_conversation_text",
    f"""SELECT conv_id, turn, unnest(range(len(p))) AS pos, unnest(p) AS piece
        FROM (SELECT conv_id, turn, {K.quoted_split('text')} AS p FROM conversations)""",
)
def _(spark, sf_dir):
    found = shred.split_text(V.table(spark, sf_dir, "conversations"), "text", keep=("conv_id", "turn"))
    return found.select("conv_id", "turn", big("pos"), "piece")


@register(
    "written_values",
    f"""SELECT seq, pos, {K.unquoted('t')} AS value FROM (
        SELECT seq, unnest(range(len(tokens))) AS pos, unnest(tokens) AS t FROM value_tokens)""",
)
def _(spark, sf_dir):
    return shred.written_values(V.query_log(spark, sf_dir)).select("seq", big("pos"), "value")


@register(
    "multirow_values",
    f"""SELECT seq, row_no, pos, {K.unquoted('t')} AS value FROM (
        SELECT seq, row_no, unnest(range(len(r))) AS pos, unnest(r) AS t FROM (
            SELECT seq, unnest(range(len(many))) AS row_no, unnest(many) AS r FROM value_tokens WHERE len(many) > 0))""",
)
def _(spark, sf_dir):
    found = shred.multirow_values(V.query_log(spark, sf_dir))
    return found.select("seq", big("row", "row_no"), big("pos"), "value")


@register(
    "bulk_loads",
    f"""SELECT seq, {K.found('s', K.BULK, 1)} AS table_name, {K.found('s', K.BULK, 2)} AS path FROM statements
        WHERE regexp_matches(s, {K.q(K.BULK)})""",
)
def _(spark, sf_dir):
    return shred.bulk_loads(V.query_log(spark, sf_dir)).withColumnRenamed("table", "table_name")


@register(
    "merges",
    f"""SELECT seq, {K.plain_name(f"regexp_extract(s, {K.q(K.MERGE)}, 1)")} AS target,
        array_to_string(list_filter(list_transform({K.quoted_split(f"regexp_extract(s, {K.q(K.MERGE_UPD)}, 1)")},
            lambda p: trim(regexp_replace(trim(split_part(p, '=', 1), {K.WS}), '^\\w+\\.', ''), ' []')), lambda n: n <> ''), '|')
            AS updated,
        array_to_string(list_filter({K.names_split(f"regexp_extract(s, {K.q(K.MERGE_INS)}, 1)")}, lambda n: n <> ''), '|')
            AS inserted
        FROM statements WHERE regexp_matches(s, {K.q(K.MERGE)})""",
)
def _(spark, sf_dir):
    found = shred.merges(V.query_log(spark, sf_dir))
    return found.select("seq", "target", F.array_join("updated", "|").alias("updated"), F.array_join("inserted", "|").alias("inserted"))


@register(
    "selects",
    "SELECT seq, tbl AS table_name, array_to_string(expressions, '|') AS expressions, lst = '*' AS star FROM selects",
)
def _(spark, sf_dir):
    found = shred.selects(V.query_log(spark, sf_dir))
    return found.select("seq", F.col("table").alias("table_name"), F.array_join("expressions", "|").alias("expressions"), "star")


@register(
    "plain_table_names",
    f"""SELECT {K.plain_name(f"regexp_extract(s, {K.q(K.FROM)}, 1)")} AS table_name, count(*) AS n FROM statements
        WHERE regexp_matches(s, {K.q(K.FROM)}) GROUP BY 1""",
)
def _(spark, sf_dir):
    sql = strip(F.col("sql_text"))
    texts = V.query_log(spark, sf_dir).where(sql.rlike(S.FROM_TABLE))
    return texts.groupBy(plain_name(F.regexp_extract(sql, S.FROM_TABLE, 1)).alias("table_name")).agg(F.count("*").alias("n"))


@register("rpc_params", "SELECT seq, proc, pos, name, value FROM rpc_params")
def _(spark, sf_dir):
    return shred.rpc_params(V.rpc_calls(V.query_log(spark, sf_dir))).select("seq", "proc", big("pos"), "name", "value")


_LITERAL = (
    "lambda t: CASE WHEN regexp_matches({v}, '^-?\\d+(\\.\\d+)?$') THEN {v} ELSE concat('''', replace({v}, '''', ''''''), '''') END"
)


def _literals(tokens: str) -> str:
    # Tokens as values again: outer quotes off, doubled quotes single, numbers bare.
    v = f"CASE WHEN starts_with(t, '''') AND ends_with(t, '''') THEN replace({K.unquoted('t')}, '''''', '''') ELSE t END"
    return f"list_transform({tokens}, {_LITERAL.format(v=v)})"


@register(
    "rebuilt_inserts",
    f"""SELECT seq, concat(regexp_extract(sql_text, '(?is)^(.*?values\\s*\\()', 1), array_to_string({_literals('tokens')}, ', '),
            regexp_extract(sql_text, '(?is)values\\s*\\([^)]+(\\).*)$', 1)) AS rebuilt
        FROM value_tokens WHERE i_vals IS NOT NULL""",
)
def _(spark, sf_dir):
    texts = V.query_log(spark, sf_dir)
    literals = F.transform(
        S.insert_tokens(strip(F.col("sql_text"))), lambda t: S.rewritten_token(t, F.lit(None).cast("string"))
    )
    rebuilt = texts.select("seq", S.rebuilt_insert(F.col("sql_text"), literals).alias("rebuilt"))
    return rebuilt.where(F.col("rebuilt").isNotNull())


@register(
    "rebuilt_updates",
    f"""SELECT seq, concat(regexp_extract(sql_text, '(?is)^(.*?\\sset\\s+)', 1),
            array_to_string(list_transform(list_zip(u_cols, {_literals('tokens')}, true), lambda z: concat(z[1], ' = ', z[2])), ', '),
            regexp_extract(sql_text, '(?is)(\\s+where\\s.+)$', 1)) AS rebuilt
        FROM value_tokens WHERE u_set IS NOT NULL""",
)
def _(spark, sf_dir):
    sql = strip(F.col("sql_text"))
    literals = F.transform(S.update_tokens(sql), lambda t: S.rewritten_token(t, F.lit(None).cast("string")))
    rebuilt = V.query_log(spark, sf_dir).select(
        "seq", S.rebuilt_update(F.col("sql_text"), S.update_columns(sql), literals).alias("rebuilt")
    )
    return rebuilt.where(F.col("rebuilt").isNotNull())


@register(
    "rebuilt_multirow_inserts",
    f"""SELECT seq, concat(regexp_extract(sql_text, '(?is)^(.*?values\\s*)', 1), array_to_string(list_transform(many,
            lambda r: concat('(', array_to_string({_literals('r')}, ', '), ')')), ', ')) AS rebuilt
        FROM value_tokens WHERE len(many) > 0""",
)
def _(spark, sf_dir):
    raw = F.col("sql_text")
    rows = F.transform(
        S.multirow_tokens(raw),
        lambda row: F.transform(row, lambda t: S.rewritten_token(t, F.lit(None).cast("string"))),
    )
    rebuilt = V.query_log(spark, sf_dir).select("seq", S.rebuilt_rows(raw, rows).alias("rebuilt"))
    return rebuilt.where(F.col("rebuilt").isNotNull())


@register(
    "statement_prefilter",
    """SELECT seq, sql_text FROM query_log WHERE contains(lower(sql_text), 'insert ') OR contains(lower(sql_text), 'update ')
        OR contains(lower(sql_text), 'delete ') OR contains(lower(sql_text), 'select ')""",
)
def _(spark, sf_dir):
    return shred.with_keyword(V.query_log(spark, sf_dir)).select("seq", "sql_text")


@register("select_filter", "SELECT seq, sql_text FROM statements WHERE starts_with(lower(s), 'select ')")
def _(spark, sf_dir):
    return V.query_log(spark, sf_dir).where(S.is_select(F.col("sql_text"))).select("seq", "sql_text")


# -- packets ---------------------------------------------------------------------------------------------------------
_PARTS = """(SELECT *, n // 2 AS half FROM (SELECT seq, sql_text, length(sql_text) AS n FROM query_log WHERE sql_text <> ''))"""


@register(
    "packet_headers",
    f"""SELECT seq % 2 AS conn_id, seq * 2 + part AS seq, CASE WHEN starts_with(sql_text, 'dbo.') THEN 3 ELSE 1 END::BIGINT AS type,
        part AS status, 8 + 2 * CASE part WHEN 0 THEN half ELSE n - half END AS length, seq % 1000 AS spid, part + 1 AS packet,
        0::BIGINT AS "window", CASE WHEN starts_with(sql_text, 'dbo.') THEN 'RPC' ELSE 'SQL Batch' END AS type_name
        FROM {_PARTS}, range(2) AS r(part)""",
)
def _(spark, sf_dir):
    found = packets.decode_packets(V.packets(spark, sf_dir))
    fields = ("type", "status", "length", "spid", "packet", "window")
    return found.select("conn_id", "seq", *[big(f) for f in fields], "type_name")


@register(
    "reassembled_messages",
    """SELECT seq % 2 AS conn_id, CASE WHEN starts_with(sql_text, 'dbo.') THEN 3 ELSE 1 END::BIGINT AS type,
        seq * 2 + 1 AS end_seq, seq % 1000 AS spid, sql_text AS text FROM query_log WHERE sql_text <> ''""",
)
def _(spark, sf_dir):
    found = packets.reassemble_messages(V.packets(spark, sf_dir))
    return found.select("conn_id", big("type"), "end_seq", big("spid"), "text")


@register(
    "payload_texts",
    """SELECT doc_id, text AS decoded, CASE WHEN length(text) = 0 THEN 0 ELSE 1 END::BIGINT AS filled FROM documents""",
)
def _(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").withColumn("payload", F.encode("text", "UTF-16LE"))
    decoded = docs.withColumn("decoded", B.utf16_or_latin1(F.col("payload")))
    same = B.utf16_lenient(F.col("payload")) == F.col("decoded")
    return decoded.select("doc_id", "decoded", F.when(same & (F.length("decoded") > 0), 1).otherwise(0).cast("bigint").alias("filled"))


# -- policy ----------------------------------------------------------------------------------------------------------
@register(
    "rule_admission",
    """SELECT ord, id, target, action FROM rule_table WHERE lower(target) IN ('table', 'column', 'pattern')
        AND lower(action) IN ('allow', 'block', 'autocorrect') AND selector IS NOT NULL AND id IS NOT NULL""",
)
def _(spark, sf_dir):
    return policy.admit_rules(V.sql_view(spark, sf_dir, V.RULE_TABLE, "part")).select("ord", "id", "target", "action")


@register(
    "rule_validation",
    """SELECT ord, error FROM (SELECT *, CASE
            WHEN coalesce(id, '""') = '""' OR NOT starts_with(id, '"') THEN 'id must be a non-empty string'
            WHEN target NOT IN ('"table"', '"column"', '"pattern"')
                THEN 'target must be one of [''column'', ''pattern'', ''table'']'
            WHEN selector = '""' THEN 'selector must be a non-empty string'
            WHEN action NOT IN ('"allow"', '"block"', '"autocorrect"')
                THEN 'action must be one of [''allow'', ''autocorrect'', ''block'']'
            WHEN reason = '12' THEN 'reason must be a string if provided'
            WHEN confidence IN ('"0.5"', '1.5', '-0.1') THEN 'confidence must be a number between 0 and 1'
            WHEN enabled IN ('"yes"', '1') THEN 'enabled must be boolean if provided'
            WHEN apply_in_envs IN ('"dev"', '[1]') THEN 'apply_in_envs must be a list of strings'
            WHEN min_hits_to_enforce IN ('-1', '2.5', 'null') THEN 'min_hits_to_enforce must be a non-negative integer'
            END AS error FROM raw_rules) WHERE error IS NOT NULL
        UNION ALL
        SELECT ord, concat('duplicate id: ', trim(id, '"')) FROM (
            SELECT ord, id, row_number() OVER (PARTITION BY id ORDER BY ord) AS nth FROM raw_rules
            WHERE coalesce(id, '""') <> '""' AND starts_with(id, '"') AND target IN ('"table"', '"column"', '"pattern"')
                AND selector <> '""' AND action IN ('"allow"', '"block"', '"autocorrect"') AND coalesce(reason, '') <> '12'
                AND coalesce(confidence, '') NOT IN ('"0.5"', '1.5', '-0.1') AND coalesce(enabled, '') NOT IN ('"yes"', '1')
                AND coalesce(apply_in_envs, '') NOT IN ('"dev"', '[1]')
                AND coalesce(min_hits_to_enforce, '') NOT IN ('-1', '2.5', 'null')) WHERE nth > 1""",
)
def _(spark, sf_dir):
    return policy.validate_rules(V.sql_view(spark, sf_dir, V.RAW_RULES, "part"))


def _decided(spark, sf_dir, rules, form="auto", env=None):
    return policy.decide(V.policy_events(spark, sf_dir), rules, env, form)


def _register_target(target: str) -> None:
    rows = [r for r in V.RULES if r[2] == target]
    text = K.matched("policy_events", "tbl", "col", "sql_text", rules=f"({K.rule_values(rows)})")

    @register(f"match_{target}_rules", f"SELECT seq, col AS column_name, value, action, rule_id FROM ({text})")
    def _(spark, sf_dir):
        found = _decided(spark, sf_dir, V.rules(spark, rows))
        return found.select("seq", F.col("column").alias("column_name"), "value", "decision.action", "decision.rule_id")


for _target in ("table", "column", "pattern"):
    _register_target(_target)


@register(
    "match_patterns_in_documents",
    """SELECT d.doc_id, coalesce(r.action, 'allow') AS action, r.id AS rule_id FROM documents AS d
        LEFT JOIN (SELECT doc_id, min(ord) AS first FROM documents JOIN (VALUES (0, 'licen'), (1, '@'), (2, 'THE '), (3, '07'))
            AS p(ord, sel) ON contains(lower(text), lower(sel)) GROUP BY doc_id) AS m ON m.doc_id = d.doc_id
        LEFT JOIN (VALUES (0, 'license', 'block'), (1, 'address', 'autocorrect'), (2, 'english', 'allow'),
            (3, 'digits', 'block')) AS r(ord, id, action) ON r.ord = m.first""",
)
def _(spark, sf_dir):
    rows = [
        (n, rid, "pattern", sel, action, "", 1.0, True, None, 0)
        for n, (rid, sel, action) in enumerate(
            [("license", "licen", "block"), ("address", "@", "autocorrect"), ("english", "THE ", "allow"), ("digits", "07", "block")]
        )
    ]
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("sql_text"))
    found = policy.decide(docs, V.rules(spark, rows))
    return found.select("doc_id", "decision.action", "decision.rule_id")


_IN_PRODUCTION = "(SELECT * FROM rules WHERE envs IS NULL OR len(envs) = 0 OR list_contains(list_transform(envs, lambda e: lower(e)), 'production'))"


@register(
    "environment_gate",
    f"""SELECT action, rule_id, count(*) AS n FROM ({K.matched('policy_events', 'tbl', 'col', 'sql_text', rules=_IN_PRODUCTION)})
        GROUP BY action, rule_id""",
)
def _(spark, sf_dir):
    found = _decided(spark, sf_dir, V.rules(spark), env="Production")
    return found.groupBy("decision.action", "decision.rule_id").agg(F.count("*").alias("n"))


_DECIDED_SQL = "SELECT seq, col AS column_name, value, action, reason, confidence, rule_id FROM policy_decided"


def _decision_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "seq", F.col("column").alias("column_name"), "value", "decision.action", "decision.reason", "decision.confidence",
        "decision.rule_id",
    )


@register("decide_compiled", _DECIDED_SQL)
def _(spark, sf_dir):
    return _decision_rows(_decided(spark, sf_dir, V.rules(spark), "compiled"))


@register("decide_by_joins", _DECIDED_SQL)
def _(spark, sf_dir):
    return _decision_rows(_decided(spark, sf_dir, V.rules(spark), "join"))


@register("decide_with_200_rules", _DECIDED_SQL)
def _(spark, sf_dir):
    return _decision_rows(_decided(spark, sf_dir, V.rules_many(spark, 200)))


@register("decide_with_2000_rules", _DECIDED_SQL)
def _(spark, sf_dir):
    return _decision_rows(_decided(spark, sf_dir, V.rules_many(spark, 2000)))


@register(
    "decide_with_many_patterns",
    f"""SELECT seq, action, rule_id FROM ({K.matched('events_of_statements', 'tbl', 'col', 'sql_text')})""",
)
def _(spark, sf_dir):
    texts = V.query_log(spark, sf_dir).where(F.col("sql_text") != "").select("seq", "sql_text")
    return policy.decide(texts, V.patterns_many(spark, 400)).select("seq", "decision.action", "decision.rule_id")


@register(
    "decide_with_patterns_by_pieces",
    f"""SELECT seq, action, rule_id FROM ({K.matched('events_of_statements', 'tbl', 'col', 'sql_text')})""",
)
def _(spark, sf_dir):
    texts = V.query_log(spark, sf_dir).where(F.col("sql_text") != "").select("seq", "sql_text")
    return policy.decide(texts, V.patterns_many(spark, 5000)).select("seq", "decision.action", "decision.rule_id")


@register(
    "decide_documents_by_pieces",
    """SELECT d.doc_id, p.ord AS rule_ord FROM documents AS d LEFT JOIN (SELECT d.doc_id AS id, min(ord) AS ord FROM documents AS d
        JOIN (SELECT doc_id::BIGINT AS ord, lower(substr(text, 1 + (doc_id % 40)::INT, CASE WHEN doc_id % 251 = 250 THEN 1 ELSE 6 END)) AS s
            FROM documents WHERE text <> '') AS p ON d.text <> '' AND p.s <> '' AND contains(lower(d.text), p.s) GROUP BY d.doc_id) AS p ON p.id = d.doc_id""",
)
def _(spark, sf_dir):
    """Each document gives a pattern (some of one letter) that other documents hold; rows have a repeated, partly null seq."""
    docs = V.table(spark, sf_dir, "documents")
    cut = F.expr("substr(text, 1 + CAST(doc_id % 40 AS INT), CASE WHEN doc_id % 251 = 250 THEN 1 ELSE 6 END)")
    given = docs.where("text <> ''").select(
        F.col("doc_id").cast("int").alias("ord"), F.concat(F.lit("doc-"), "doc_id").alias("id"), F.lit("pattern").alias("target"),
        cut.alias("selector"), F.lit("block").alias("action"), F.lit("").alias("reason"), F.lit(1.0).alias("confidence"),
        F.lit(True).alias("enabled"), F.lit(None).cast("array<string>").alias("apply_in_envs"), F.lit(0).alias("min_hits_to_enforce"),
    ).where("selector <> ''")
    texts = docs.select("doc_id", F.col("text").alias("sql_text"), F.expr("nullif(doc_id % 3, 0)").alias("seq"))
    ruleset = policy.RuleSet.prepare(given, form="join")
    low = F.lower(F.nullif("sql_text", F.lit("")))
    found = policy._match_by_pieces(texts, low, ruleset.of("pattern"), "m", ruleset.small)
    return found.select("doc_id", big("m.ord", "rule_ord"))


@register(
    "lookup_rules",
    """SELECT d.seq, d.rule_id, r.selector, r.min_hits::BIGINT AS min_hits FROM statement_decisions AS d
        LEFT JOIN rules AS r ON r.id = d.rule_id""",
)
def _(spark, sf_dir):
    decided = correct.statement_decisions(V.query_log(spark, sf_dir), V.rules(spark)).select("seq", "rule_id")
    found = policy.lookup_rules(decided, V.rules(spark))
    return found.select("seq", "rule_id", "rule.selector", F.col("rule.min_hits_to_enforce").cast("bigint").alias("min_hits"))


@register(
    "statement_decisions",
    "SELECT seq, action, reason, confidence, rule_id, left(sql_text, 200) AS sample FROM statement_decisions",
)
def _(spark, sf_dir):
    found = correct.statement_decisions(V.query_log(spark, sf_dir), V.rules(spark))
    return found.select("seq", "action", "reason", "confidence", "rule_id", "sample")


@register(
    "cell_corrections",
    """SELECT seq, row_no, pos, col AS column_name, value AS before, normalized AS after, rule_id FROM cell_corrections""",
)
def _(spark, sf_dir):
    found = correct.cell_corrections(V.query_log(spark, sf_dir), V.rules(spark))
    return found.select(
        "seq", big("row", "row_no"), big("pos"), F.col("column").alias("column_name"), "before", "after", "rule_id"
    )


# Statements whose own decision is a block are left alone when rules are enforced.
_ENFORCED = """SELECT c.* FROM cell_corrections AS c WHERE c.seq NOT IN (SELECT seq FROM statement_decisions WHERE action = 'block')"""


@register(
    "corrected_statements",
    f"""SELECT v.seq, CASE WHEN u_set IS NOT NULL AND many IS NULL
            THEN concat(regexp_extract(sql_text, '(?is)^(.*?\\sset\\s+)', 1),
                array_to_string(list_transform(list_zip(u_cols, lits[1]), lambda z: concat(z[1], ' = ', z[2])), ', '),
                regexp_extract(sql_text, '(?is)(\\s+where\\s.+)$', 1))
            ELSE concat(regexp_extract(sql_text, '(?is)^(.*?values\\s*)', 1),
                array_to_string(list_transform(lits, lambda r: concat('(', array_to_string(r, ', '), ')')), ', ')) END AS corrected
        FROM (SELECT seq, list(row_lits ORDER BY row_no) AS lits FROM (
            SELECT c.seq, c.row_no, list(CASE WHEN regexp_matches(x, '^-?\\d+(\\.\\d+)?$') THEN x
                ELSE concat('''', replace(replace(x, '''''', ''''), '''', ''''''), '''') END ORDER BY c.pos) AS row_lits
            FROM (SELECT cells.seq, cells.row_no, cells.pos, coalesce(e.normalized, cells.value) AS x FROM cells
                LEFT JOIN ({_ENFORCED}) AS e ON e.evt = cells.evt
                WHERE cells.seq IN (SELECT seq FROM ({_ENFORCED}))) AS c GROUP BY c.seq, c.row_no) GROUP BY seq) AS t
        JOIN value_tokens AS v ON v.seq = t.seq""",
)
def _(spark, sf_dir):
    log = V.query_log(spark, sf_dir)
    cells = correct.cell_corrections(log, V.rules(spark), mode="enforce")
    return correct.corrected_statements(log, cells).select("seq", "corrected")


_HITS = f"""(SELECT seq, 0 AS step, 0 AS row_no, 0 AS pos, action, rule_id FROM statement_decisions
        WHERE action IN ('block', 'autocorrect') AND rule_id IS NOT NULL
    UNION ALL SELECT seq, 1, row_no, pos, action, rule_id FROM ({_ENFORCED}))"""
_GATES = f"""(SELECT h.seq, h.rule_id, CASE WHEN r.min_hits > 0 THEN h.hits END AS hits, r.min_hits::BIGINT AS min_hits,
        r.min_hits <= 0 OR h.hits >= r.min_hits AS enforced
    FROM (SELECT *, count(*) OVER (PARTITION BY rule_id ORDER BY seq, step, row_no, pos) AS hits FROM {_HITS}) AS h
    JOIN rules AS r ON r.id = h.rule_id WHERE h.step = 0 AND h.action = 'block')"""


# A column rule that blocks has no effect on the cells of statements.
_WITH_COLUMN_BLOCK = [*V.RULES, (8, "ref-column", "column", "Ref", "block", "No references", 0.5, True, None, 0)]
_IGNORED = """(SELECT seq, count(*) AS n FROM cell_decisions WHERE action = 'allow' AND col = 'dbo.Orders.Ref' GROUP BY seq)"""


def _enforced_log(spark, sf_dir) -> DataFrame:
    """Statement and cell decisions under enforcement, written once: the steps behind it read it several times."""
    log, rules = V.query_log(spark, sf_dir), V.rules(spark)
    parts = correct.statement_decisions(log, rules).unionByName(correct.cell_corrections(log, rules, mode="enforce"))
    return materialize(parts, "decisions")


@register("threshold_gates", f"SELECT seq, rule_id, hits, min_hits, enforced FROM {_GATES}")
def _(spark, sf_dir):
    return correct.apply_thresholds(_enforced_log(spark, sf_dir), V.rules(spark))


@register(
    "statement_outcomes",
    f"""SELECT d.seq, CASE WHEN g.enforced THEN 'blocked' WHEN NOT g.enforced THEN 'gated' WHEN c.seq IS NOT NULL THEN 'rewritten'
            ELSE 'forwarded' END AS outcome, coalesce(i.n, 0) AS block_ignored
        FROM statement_decisions AS d LEFT JOIN {_GATES} AS g ON g.seq = d.seq
        LEFT JOIN (SELECT DISTINCT seq FROM ({_ENFORCED})) AS c ON c.seq = d.seq LEFT JOIN {_IGNORED} AS i ON i.seq = d.seq""",
)
def _(spark, sf_dir):
    log, rules = V.query_log(spark, sf_dir), V.rules(spark, _WITH_COLUMN_BLOCK)
    cells = materialize(correct.decided_cells(log, rules), "cells")
    fixed = correct.cell_corrections(log, rules, mode="enforce", decided=cells)
    decided = materialize(correct.statement_decisions(log, rules).unionByName(fixed), "decisions")
    return correct.statement_outcomes(decided, rules, "enforce", ignored=correct.ignored_blocks(log, rules, decided=cells))


@register(
    "gates_of_unknown_rules",
    f"""SELECT h.seq, h.rule_id, NULL::BIGINT AS hits, 0::BIGINT AS min_hits, true AS enforced FROM {_HITS} AS h
        WHERE h.step = 0 AND h.action = 'block'""",
)
def _(spark, sf_dir):
    """A log names rules that are no longer in the table: their blocks hold."""
    gone = V.rules(spark).where(F.col("action") != "block")
    return correct.apply_thresholds(_enforced_log(spark, sf_dir), gone)


@register(
    "rpc_param_decisions",
    "SELECT seq, pos, name AS param, left(value, 80) AS value, action, reason, rule_id FROM param_decisions",
)
def _(spark, sf_dir):
    found = rpc.param_decisions(shred.rpc_params(V.rpc_calls(V.query_log(spark, sf_dir))), V.rules(spark))
    return found.select("seq", big("pos"), "param", "value", "action", "reason", "rule_id")


@register(
    "rpc_call_outcomes",
    "SELECT seq, bool_or(action = 'block') AS has_block, bool_or(action = 'block') AS blocked FROM param_decisions GROUP BY seq",
)
def _(spark, sf_dir):
    found = rpc.param_decisions(shred.rpc_params(V.rpc_calls(V.query_log(spark, sf_dir))), V.rules(spark))
    return rpc.call_outcomes(found, "enforce")


# Under these rules the phone of a call is corrected and nothing is blocked. Values get a blank on even statements, so
# some corrections fit and others do not.
_PHONE_RULE = [(0, "phone-param", "column", "@phone", "autocorrect", "Phone numbers in one format", 0.9, True, None, 0)]


@register(
    "fixed_width_corrections",
    """SELECT seq, 'Phone' AS name, before, after, CASE WHEN length(after) <= length(before) THEN rpad(after, length(before)::INT, ' ')
            ELSE left(after, length(before)) END AS written, length(after) > length(before) AS truncated,
        replace(text, before, CASE WHEN length(after) <= length(before) THEN rpad(after, length(before)::INT, ' ')
            ELSE left(after, length(before)) END) AS corrected_text
        FROM (SELECT seq, replace(sql_text, '''070', CASE WHEN seq % 4 = 0 THEN '''070 - ' ELSE '''070' END) AS text,
            concat(CASE WHEN seq % 4 = 0 THEN '070 - ' ELSE '070' END, lpad(substr(user_name, 2), 7, '0')) AS before,
            concat(CASE WHEN seq % 4 = 0 THEN '+4670-' ELSE '+4670' END, lpad(substr(user_name, 2), 7, '0')) AS after
            FROM query_log WHERE starts_with(sql_text, 'dbo.'))""",
)
def _(spark, sf_dir):
    calls = V.rpc_calls(V.query_log(spark, sf_dir))
    spaced = F.when(F.col("seq") % 4 == 0, F.lit("070 - ")).otherwise(F.lit("070"))
    calls = calls.withColumn("sql_text", F.replace("sql_text", F.lit("'070"), F.concat(F.lit("'"), spaced)))
    found = rpc.fixed_width_corrections(calls, shred.rpc_params(calls), V.rules(spark, _PHONE_RULE), truncate=True)
    return found.select("seq", "name", "before", "after", "written", "truncated", "corrected_text")


@register(
    "rpc_param_types",
    """SELECT seq, pos, name, CASE lower(name) WHEN 'customerid' THEN 'int' ELSE 'nvarchar' END AS type FROM rpc_params""",
)
def _(spark, sf_dir):
    params = shred.rpc_params(V.rpc_calls(V.query_log(spark, sf_dir)))
    return rpc.param_types(params, V.param_types(spark)).select("seq", big("pos"), "name", "type")


_DECLARED = """SELECT concat('Dbo.Proc', p_partkey) AS proc,
    CASE p_partkey % 3 WHEN 0 THEN '@Phone' WHEN 1 THEN 'CustomerId' ELSE '@other' END AS param,
    CASE p_partkey % 4 WHEN 0 THEN 'INT' WHEN 1 THEN 'money' WHEN 2 THEN 'bit' ELSE 'nvarchar' END AS type FROM {part}"""


@register(
    "rpc_param_types_declared",
    f"""SELECT r.seq, r.pos, r.name, CASE WHEN lower(t.type) IN ('int', 'bit', 'nvarchar') THEN lower(t.type) ELSE 'nvarchar' END AS type
        FROM (SELECT *, CASE WHEN seq % 5 = 0 THEN NULL ELSE concat('DBO.proc', seq % 3000) END AS p FROM rpc_params) AS r
        LEFT JOIN ({_DECLARED.format(part="part")}) AS t ON lower(t.proc) = lower(r.p) AND lower(replace(t.param, '@', '')) = lower(r.name)""",
)
def _(spark, sf_dir):
    """Procedures that are missing or not declared, parameters of other procedures, types that are not known."""
    params = shred.rpc_params(V.rpc_calls(V.query_log(spark, sf_dir)))
    proc = F.when(F.col("seq") % 5 != 0, F.concat(F.lit("DBO.proc"), (F.col("seq") % 3000).cast("string")))
    types = V.sql_view(spark, sf_dir, _DECLARED, "part")
    return rpc.param_types(params.withColumn("proc", proc), types).select("seq", big("pos"), "name", "type")


@register(
    "sniff_counters",
    """SELECT CASE action WHEN 'block' THEN 'blocks' WHEN 'autocorrect' THEN 'autocorrect_suggested' ELSE 'allowed' END AS key,
        count(*) AS n FROM statement_decisions WHERE regexp_matches(lower(sql_text), '(insert|update|delete|select) ') GROUP BY 1""",
)
def _(spark, sf_dir):
    return correct.sniff_counters(V.query_log(spark, sf_dir), V.rules(spark))


@register(
    "oversized_rewrites",
    "SELECT doc_id, 8 + 2 * length(text) > 2000 AS rewrite_skipped_size FROM documents",
)
def _(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    return correct.oversized_rewrites(docs, "text", cap=2000).select("doc_id", "rewrite_skipped_size")


_EVALUATED = "(SELECT coalesce(rule_id, '(no_rule)') AS rule, * FROM policy_decided)"


@register(
    "evaluate_rules",
    f"""SELECT 'total' AS part, '' AS rule, action AS name, count(*) AS n FROM policy_decided GROUP BY action
        UNION ALL SELECT 'rule', rule, action, count(*) FROM {_EVALUATED} GROUP BY rule, action
        UNION ALL SELECT 'sample', rule, sql_text, rank FROM (SELECT rule, sql_text,
            row_number() OVER (PARTITION BY rule ORDER BY seq, col, value) AS rank FROM {_EVALUATED}) WHERE rank <= 3""",
)
def _(spark, sf_dir):
    decided = _decided(spark, sf_dir, V.rules(spark))
    totals, counts, samples = D.evaluate(decided.withColumn("rule_id", F.lit(None)), ("seq", "column", "value"))
    one = lambda df, part, rule, name, n: df.select(
        F.lit(part).alias("part"), rule.alias("rule"), name.alias("name"), n.cast("bigint").alias("n")
    )
    return (
        one(totals, "total", F.lit(""), F.col("action"), F.col("n"))
        .unionByName(one(counts, "rule", F.col("rule"), F.col("action"), F.col("n")))
        .unionByName(one(samples, "sample", F.col("rule"), F.col("sample"), F.col("rank")))
    )


@register(
    "snapshot_diff",
    """SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END
            AS change, b.selector AS old_selector, a.selector AS new_selector, b.min_hits AS old_hits, a.min_hits AS new_hits
        FROM rules_before AS b FULL OUTER JOIN rules_after AS a ON a.id = b.id
        WHERE b.id IS NULL OR a.id IS NULL OR a.selector IS DISTINCT FROM b.selector OR a.action IS DISTINCT FROM b.action
            OR a.min_hits IS DISTINCT FROM b.min_hits""",
)
def _(spark, sf_dir):
    before = V.sql_view(spark, sf_dir, V.RULES_BEFORE, "part")
    after = V.sql_view(spark, sf_dir, V.RULES_AFTER, "part")
    return policy.snapshot_diff(before, after, "id").select(
        "id", "change", F.col("current.selector").alias("old_selector"), F.col("proposed.selector").alias("new_selector"),
        F.col("current.min_hits").alias("old_hits"), F.col("proposed.min_hits").alias("new_hits"),
    )


@register(
    "suggest_rules",
    """SELECT conv_id, turn, CASE WHEN contains(low, 'email') AND regexp_matches(low, 'require|krav|måste|must') THEN 'no-null-email'
            WHEN regexp_matches(low, 'phone|telefon') THEN 'phone-autocorrect' ELSE 'suggest-1' END AS id,
        CASE WHEN contains(low, 'email') AND regexp_matches(low, 'require|krav|måste|must') THEN 'Email'
            WHEN regexp_matches(low, 'phone|telefon') THEN 'Phone' ELSE 'INSERT INTO' END AS selector
        FROM (SELECT *, lower(text) AS low FROM requests)""",
)
def _(spark, sf_dir):
    texts = V.sql_view(spark, sf_dir, V.REQUESTS, "conversations")
    return policy.suggest_rules(texts, "text").select("conv_id", "turn", "suggested.id", "suggested.selector")


# -- profiles --------------------------------------------------------------------------------------------------------
@register("write_counts", "SELECT concat(tbl, '.', col) AS field, count(*) AS n FROM profile_columns GROUP BY 1")
def _(spark, sf_dir):
    return profiles.write_counts(V.query_log(spark, sf_dir))


@register("suggestion_counts", "SELECT field, kind, n FROM profile_kinds")
def _(spark, sf_dir):
    return profiles.suggestion_counts(V.query_log(spark, sf_dir))


def _profiles(spark, sf_dir) -> DataFrame:
    return profiles.field_profiles(V.query_log(spark, sf_dir))


_KINDS = "(SELECT field, string_agg(concat(kind, ':', n), ', ' ORDER BY kind) AS kinds FROM profile_kinds GROUP BY field)"


SQL_OF_PROFILES = f"""SELECT p.field, n_writes AS count, n_nulls AS nulls, coalesce(kinds, '') AS kinds FROM profiles AS p
    LEFT JOIN {_KINDS} AS k ON k.field = p.field"""


@register("field_profiles", SQL_OF_PROFILES)
def _(spark, sf_dir):
    entries = F.transform(F.array_sort(F.map_entries("suggestions")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return _profiles(spark, sf_dir).select("field", "count", "nulls", F.array_join(entries, ", ").alias("kinds"))


@register(
    "select_columns",
    "SELECT tbl AS table_name, e AS expression, count(*) AS n FROM (SELECT tbl, unnest(expressions) AS e FROM selects) GROUP BY 1, 2",
)
def _(spark, sf_dir):
    return profiles.select_columns(V.query_log(spark, sf_dir)).withColumnRenamed("table", "table_name")


@register("select_stars", "SELECT tbl AS table_name, count_if(lst = '*')::BIGINT AS star FROM selects GROUP BY 1")
def _(spark, sf_dir):
    return profiles.select_stars(V.query_log(spark, sf_dir)).withColumnRenamed("table", "table_name")


@register(
    "select_summary",
    """SELECT tbl AS table_name, e AS expression, count(*) AS n, 0::BIGINT AS star FROM
            (SELECT tbl, unnest(expressions) AS e FROM selects) GROUP BY 1, 2
        UNION ALL SELECT tbl, NULL, 0, count_if(lst = '*')::BIGINT FROM selects GROUP BY tbl""",
)
def _(spark, sf_dir):
    return profiles.select_usage(V.query_log(spark, sf_dir)).withColumnRenamed("table", "table_name")


def _two_profiles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Profiles of two groups of clients, in place of two days."""
    log = V.query_log(spark, sf_dir)
    first = F.col("client_app").isin("click", "view")
    return profiles.field_profiles(log.where(first)), profiles.field_profiles(log.where(~first))


@register(
    "null_drift",
    """SELECT field, drift FROM (SELECT coalesce(p.field, c.field) AS field, abs(coalesce(c.n_nulls, 0) / greatest(coalesce(c.n_writes, 0), 1)
            - coalesce(p.n_nulls, 0) / greatest(coalesce(p.n_writes, 0), 1)) AS drift
        FROM profiles_prev AS p FULL OUTER JOIN profiles_curr AS c ON c.field = p.field) WHERE drift >= 0.0001""",
)
def _(spark, sf_dir):
    return profiles.null_drift(*_two_profiles(spark, sf_dir), threshold=0.0001)


@register(
    "top_drift",
    """SELECT field, round(drift, 6) AS drift FROM (SELECT coalesce(p.field, c.field) AS field, abs(coalesce(c.n_nulls, 0)
            / greatest(coalesce(c.n_writes, 0), 1) - coalesce(p.n_nulls, 0) / greatest(coalesce(p.n_writes, 0), 1)) AS drift
        FROM profiles_prev AS p FULL OUTER JOIN profiles_curr AS c ON c.field = p.field)
        WHERE drift >= 0 ORDER BY drift DESC, field LIMIT 10""",
)
def _(spark, sf_dir):
    drift = profiles.null_drift(*_two_profiles(spark, sf_dir), threshold=0.0)
    return drift.limit(10).select("field", F.round("drift", 6).alias("drift"))


def _users_of(spark, sf_dir, kind: str) -> DataFrame:
    """Fields named by user: sets that grow with the log."""
    return V.query_log(spark, sf_dir).where(F.col("client_app") == kind).select(
        F.concat(F.lit("dbo.Customers."), "user_name", F.lit("."), F.hour("ts")).alias("field")
    )


def _users_sql(kind: str) -> str:
    return f"SELECT concat('dbo.Customers.', user_name, '.', hour(ts)) AS field FROM query_log WHERE client_app = '{kind}'"


@register("field_union", f"({_users_sql('click')}) UNION ({_users_sql('error')})")
def _(spark, sf_dir):
    return profiles.field_union(_users_of(spark, sf_dir, "click"), _users_of(spark, sf_dir, "error"))


@register("field_intersection", f"({_users_sql('click')}) INTERSECT ({_users_sql('error')})")
def _(spark, sf_dir):
    return profiles.field_intersection(_users_of(spark, sf_dir, "click"), _users_of(spark, sf_dir, "error"))


@register("field_difference", f"({_users_sql('click')}) EXCEPT ({_users_sql('error')})")
def _(spark, sf_dir):
    return profiles.field_difference(_users_of(spark, sf_dir, "click"), _users_of(spark, sf_dir, "error"))


_TOP_NULLS = "SELECT field, n_writes AS count, n_nulls AS nulls FROM profiles ORDER BY n_nulls DESC, field LIMIT {n}"
_TOP_ISSUES = f"""SELECT p.field, n_suggestions AS total, coalesce(kinds, '') AS kinds FROM profiles AS p
    LEFT JOIN {_KINDS} AS k ON k.field = p.field ORDER BY n_suggestions DESC, p.field LIMIT {{n}}"""


@register("top_nulls", _TOP_NULLS.format(n=10))
def _(spark, sf_dir):
    return profiles.top_nulls(_profiles(spark, sf_dir))


@register("top_format_issues", _TOP_ISSUES.format(n=10))
def _(spark, sf_dir):
    return profiles.top_suggestions(_profiles(spark, sf_dir))


@register(
    "top_select_columns",
    """SELECT tbl AS table_name, e AS expression, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY n DESC, e) AS rank
        FROM (SELECT tbl, e, count(*) AS n FROM (SELECT tbl, unnest(expressions) AS e FROM selects) GROUP BY tbl, e)) WHERE rank <= 5""",
)
def _(spark, sf_dir):
    found = profiles.top_select_columns(profiles.select_columns(V.query_log(spark, sf_dir)))
    return found.select(F.col("table").alias("table_name"), "expression", "n", big("rank"))


@register(
    "summary_top_five",
    f"""SELECT 'nulls' AS part, field, nulls AS n FROM ({_TOP_NULLS.format(n=5)})
        UNION ALL SELECT 'issues', field, total FROM ({_TOP_ISSUES.format(n=5)})""",
)
def _(spark, sf_dir):
    table = _profiles(spark, sf_dir)
    nulls = profiles.top_nulls(table, 5).select(F.lit("nulls").alias("part"), "field", F.col("nulls").alias("n"))
    issues = profiles.top_suggestions(table, 5).select(F.lit("issues").alias("part"), "field", F.col("total").alias("n"))
    return nulls.unionByName(issues)


@register(
    "profile_context",
    """SELECT concat('- ', field, ': count=', n_writes, ' nulls=', n_nulls, ' suggestions=', n_suggestions) AS line
        FROM profiles ORDER BY field LIMIT 50""",
)
def _(spark, sf_dir):
    return reports.profile_context(_profiles(spark, sf_dir)).select("line")


# -- decisions and counters ------------------------------------------------------------------------------------------
_LOG = "(SELECT *, coalesce(rule_id, '(no_rule)') AS rule, lower(action) AS act, CAST(ts AS DATE) AS ts_date FROM decisions)"


@register("totals_by_action", f"SELECT act AS action, count(*) AS n FROM {_LOG} GROUP BY 1")
def _(spark, sf_dir):
    return D.totals_by_action(V.decisions_log(spark, sf_dir))


@register("actions_by_frequency", f"SELECT act AS action, count(*) AS n FROM {_LOG} GROUP BY 1 ORDER BY n DESC, action")
def _(spark, sf_dir):
    return D.totals_by_action(V.decisions_log(spark, sf_dir)).orderBy(F.desc("n"), "action")


@register("counts_by_rule", f"SELECT rule, act AS action, count(*) AS n FROM {_LOG} GROUP BY 1, 2")
def _(spark, sf_dir):
    return D.counts_by_rule(V.decisions_log(spark, sf_dir))


_SAMPLES = f"""SELECT rule, rank, sample FROM (SELECT rule, coalesce(nullif(sample, ''), nullif(before, ''), '') AS sample,
    row_number() OVER (PARTITION BY rule ORDER BY seq, step, row_no, pos) AS rank FROM {_LOG}) WHERE rank <= 3"""


@register("samples_by_rule", _SAMPLES)
def _(spark, sf_dir):
    found = D.samples_by_rule(V.decisions_log(spark, sf_dir), D.first_sample(), ORDER)
    return found.select("rule", big("rank"), "sample")


_DAY_LOG = f"(SELECT * FROM {_LOG} WHERE ts_date = DATE '{DAY}')"


@register("decisions_of_day", f"SELECT seq, step::BIGINT AS step, pos::BIGINT AS pos, action, rule_id FROM {_DAY_LOG}")
def _(spark, sf_dir):
    found = D.of_day(V.decisions_log(spark, sf_dir), DAY)
    return found.select("seq", big("step"), big("pos"), "action", "rule_id")


@register("day_dashboard", f"SELECT rule, act AS action, count(*) AS n FROM {_DAY_LOG} GROUP BY 1, 2")
def _(spark, sf_dir):
    return D.day_dashboard(V.decisions_log(spark, sf_dir), DAY)


@register(
    "day_dashboard_filtered",
    f"""SELECT rule, act AS action, count(*) AS n FROM (SELECT * FROM {_LOG} ORDER BY seq DESC, step DESC, row_no DESC, pos DESC LIMIT 5000)
        WHERE ts_date = DATE '2024-01-28' AND rule = 'items-table' AND act = 'autocorrect' GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    log = V.decisions_log(spark, sf_dir)
    return D.day_dashboard(log, "2024-01-28", rule="items-table", action="autocorrect", last_n=5000, order=ORDER)


@register(
    "dashboard_maps",
    f"""SELECT rule, string_agg(concat(act, ':', n), ',' ORDER BY act) AS actions FROM
        (SELECT rule, act, count(*) AS n FROM {_DAY_LOG} GROUP BY 1, 2) GROUP BY rule""",
)
def _(spark, sf_dir):
    maps = D.as_maps(D.day_dashboard(V.decisions_log(spark, sf_dir), DAY))
    pairs = F.transform(F.array_sort(F.map_entries("actions")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return maps.select("rule", F.array_join(pairs, ",").alias("actions"))


@register(
    "rule_context",
    f"""SELECT rule, count_if(act = 'block')::BIGINT AS block, count_if(act = 'autocorrect')::BIGINT AS autocorrect,
        count_if(act = 'rpc_autocorrect_inplace')::BIGINT AS rpc_autocorrect_inplace FROM {_LOG} GROUP BY rule""",
)
def _(spark, sf_dir):
    return D.rule_context(V.decisions_log(spark, sf_dir))


_TAIL = f"(SELECT * FROM {_LOG} ORDER BY seq DESC, step DESC, row_no DESC, pos DESC LIMIT 50)"


@register("tail_decisions", f"SELECT seq, step::BIGINT AS step, row_no::BIGINT AS row_no, pos::BIGINT AS pos, action FROM {_TAIL}")
def _(spark, sf_dir):
    found = D.tail(V.decisions_log(spark, sf_dir), 50, ORDER)
    return found.select("seq", big("step"), big("row", "row_no"), big("pos"), "action")


@register(
    "recent_decisions",
    f"""SELECT seq, step::BIGINT AS step, pos::BIGINT AS pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, action, rule_id,
        left(reason, 120) AS reason FROM {_TAIL}""",
)
def _(spark, sf_dir):
    found = D.recent_decisions(V.decisions_log(spark, sf_dir), 50, ORDER)
    return found.select(
        "seq", big("step"), big("pos"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "action", "rule_id", "reason"
    )


_REWRITE_CAP = 200
_COUNTERS = f"""(SELECT key, CASE WHEN starts_with(key, 'rule:') THEN split_part(key, ':', 2) END AS rule,
    CASE WHEN starts_with(key, 'rule:') THEN split_part(key, ':', 3) END AS action, count(*) AS n FROM (
        SELECT key FROM increments
        UNION ALL SELECT CASE WHEN enforced THEN 'blocks' ELSE 'gated_by_threshold' END FROM {_GATES}
        UNION ALL SELECT 'rpc_seen' FROM query_log WHERE starts_with(sql_text, 'dbo.') AND contains(sql_text, '@')
        UNION ALL SELECT 'rpc_blocked' FROM (SELECT DISTINCT seq FROM param_decisions WHERE action = 'block')
        UNION ALL SELECT 'rewrite_skipped_size' FROM query_log WHERE 8 + 2 * length(sql_text) > {_REWRITE_CAP}) GROUP BY key)"""


def _counters(spark, sf_dir) -> DataFrame:
    """All counters of the log with rules enforced."""
    log, decisions = V.query_log(spark, sf_dir), V.decisions_log(spark, sf_dir)
    gates = correct.apply_thresholds(_enforced_log(spark, sf_dir), V.rules(spark))
    parts = (
        D.counter_increments(decisions)
        .unionByName(D.gate_increments(gates))
        .unionByName(D.call_increments(V.rpc_calls(log), decisions, "enforce"))
        .unionByName(D.size_increments(correct.oversized_rewrites(log, "sql_text", _REWRITE_CAP)))
    )
    return D.counters(parts)


@register("counters", f"SELECT key, rule, action, n FROM {_COUNTERS}")
def _(spark, sf_dir):
    return _counters(spark, sf_dir)


@register("rule_counters", f"SELECT action, n FROM {_COUNTERS} WHERE rule = 'customer-phone'")
def _(spark, sf_dir):
    return D.rule_counters(_counters(spark, sf_dir), "customer-phone")


@register(
    "counter_panel",
    f"""SELECT coalesce(sum(n) FILTER (key = 'autocorrect_suggested'), 0)::BIGINT AS autocorrect_suggested,
        coalesce(sum(n) FILTER (key = 'blocks'), 0)::BIGINT AS blocks, coalesce(sum(n) FILTER (action = 'block'), 0)::BIGINT AS rule_block,
        coalesce(sum(n) FILTER (action = 'autocorrect'), 0)::BIGINT AS rule_autocorrect FROM {_COUNTERS}""",
)
def _(spark, sf_dir):
    return D.counter_panel(_counters(spark, sf_dir), ("autocorrect_suggested", "blocks"), ("block", "autocorrect"))


# -- histograms and rates --------------------------------------------------------------------------------------------
def _histogram_sql(col: str, bounds: tuple, source: str) -> str:
    rows = ", ".join(f"({float(b)}::DOUBLE)" for b in bounds) + ", ('Infinity'::DOUBLE)"
    return f"""SELECT le, count_if({col} <= le)::BIGINT AS cum_count, round(sum({col}), 2)::DOUBLE AS sum, count({col}) AS count
        FROM {source}, (VALUES {rows}) AS b(le) GROUP BY le"""


@register("latency_histogram", _histogram_sql("value", metrics.LATENCY_BOUNDS_MS, "events"))
def _(spark, sf_dir):
    found = metrics.histogram(V.table(spark, sf_dir, "events"), "value", metrics.LATENCY_BOUNDS_MS)
    return found.withColumn("sum", F.round("sum", 2))


@register("bytes_histogram", _histogram_sql("size", metrics.BYTES_BOUNDS, "(SELECT CAST(strlen(text) AS DOUBLE) AS size FROM documents)"))
def _(spark, sf_dir):
    sizes = V.table(spark, sf_dir, "documents").select(F.octet_length("text").cast("double").alias("size"))
    return metrics.histogram(sizes, "size", metrics.BYTES_BOUNDS)


def _quantile_sql() -> str:
    bounds = [float(b) for b in metrics.LATENCY_BOUNDS_MS]
    rows = ", ".join(f"({i}, {b}::DOUBLE, {bounds[i - 1] if i else 0.0}::DOUBLE)" for i, b in enumerate(bounds))
    return f"""SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, total AS count, round(coalesce(min(CASE WHEN c >= 0.95 * total
            THEN low + (le - low) * (0.95 * total - below) / nullif(c - below, 0) END), {bounds[-1]}), 6) AS quantile
        FROM (SELECT w, i, le, low, c, total, coalesce(lag(c) OVER (PARTITION BY w ORDER BY i), 0) AS below FROM (
            SELECT w, i, le, low, count_if(value <= le) AS c, count(*) AS total FROM (
                SELECT value, date_trunc('minute', ts) - to_minutes(m) AS w FROM events, range(5) AS r(m)) AS e,
                (VALUES {rows}) AS b(i, le, low) GROUP BY w, i, le, low)) GROUP BY w, total"""


@register("latency_p95", _quantile_sql())
def _(spark, sf_dir):
    found = metrics.windowed_quantile(V.table(spark, sf_dir, "events"), "ts", "value")
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "count", F.round("quantile", 6).alias("quantile")
    )


@register(
    "bytes_rate",
    """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS window_start, round(sum(length(props)) / 60.0, 6)::DOUBLE AS per_second
        FROM events GROUP BY 1""",
)
def _(spark, sf_dir):
    sizes = V.table(spark, sf_dir, "events").select("ts", F.length("props").alias("size"))
    found = metrics.rate(sizes, "ts", "size")
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), F.round("per_second", 6).alias("per_second")
    )


# -- reports ---------------------------------------------------------------------------------------------------------
@register(
    "daily_report",
    f"""SELECT line FROM (VALUES ('# Daily Data Quality Report – {DAY}'), (''), ('## Top Missingness'), (''),
            ('## Format Issues & Suggestions'), (''), ('## SELECT Analysis'), (''), ('## Drift & Errors')) AS t(line)
        UNION ALL SELECT concat('- ', field, ': nulls=', nulls, ' / count=', count) FROM ({_TOP_NULLS.format(n=10)})
        UNION ALL SELECT concat('- ', field, ': ', total, ' suggestions (', kinds, ')') FROM ({_TOP_ISSUES.format(n=10)})
        UNION ALL SELECT concat('- ', s.tbl, ': select_star=', star, ', top_columns=[', coalesce(used, ''), ']') FROM
            (SELECT tbl, count_if(lst = '*') AS star FROM selects GROUP BY tbl) AS s LEFT JOIN
            (SELECT tbl, string_agg(concat(e, ':', n), ', ' ORDER BY n DESC, e) AS used FROM (SELECT tbl, e, count(*) AS n FROM
                (SELECT tbl, unnest(expressions) AS e FROM selects) GROUP BY tbl, e) GROUP BY tbl) AS u ON u.tbl = s.tbl""",
)
def _(spark, sf_dir):
    log = V.query_log(spark, sf_dir)
    first, _ = _two_profiles(spark, sf_dir)
    table = materialize(profiles.field_profiles(log), "profiles")
    usage = materialize(profiles.select_usage(log), "usage")
    return reports.daily_report(spark, DAY, table, usage, first).select("line")


@register(
    "dryrun_report",
    f"""SELECT line FROM (VALUES ('# Dry‑Run Enforcement Summary – {DAY}'), (''), ('## Totals by Action'), (''), ('## By Rule')) AS t(line)
        UNION ALL SELECT concat('- ', act, ': ', count(*)) FROM {_DAY_LOG} GROUP BY act
        UNION ALL SELECT concat('- ', rule, ': ', string_agg(concat(act, ':', n), ', ' ORDER BY n DESC, act)) FROM
            (SELECT rule, act, count(*) AS n FROM {_DAY_LOG} GROUP BY 1, 2) GROUP BY rule
        UNION ALL SELECT concat('  - sample: ', left(replace(sample, chr(10), ' '), 160)) FROM (SELECT rule,
            coalesce(nullif(sample, ''), nullif(before, ''), '') AS sample,
            row_number() OVER (PARTITION BY rule ORDER BY seq, step, row_no, pos) AS rank FROM {_DAY_LOG}) WHERE rank <= 3 AND sample <> ''""",
)
def _(spark, sf_dir):
    day = materialize(D.of_day(V.decisions_log(spark, sf_dir), DAY), "decisions")
    return reports.dryrun_report(spark, DAY, day, ORDER).select("line")


@register(
    "evaluation_report",
    f"""SELECT line FROM (VALUES ('# Dry‑Run Simulation – now'), (''), ('## Totals by Action'), (''), ('## By Rule')) AS t(line)
        UNION ALL SELECT concat('- ', action, ': ', count(*)) FROM policy_decided GROUP BY action
        UNION ALL SELECT concat('- ', rule, ': ', string_agg(concat(action, ':', n), ', ' ORDER BY action)) FROM
            (SELECT rule, action, count(*) AS n FROM {_EVALUATED} GROUP BY 1, 2) GROUP BY rule""",
)
def _(spark, sf_dir):
    totals, counts, _ = D.evaluate(_decided(spark, sf_dir, V.rules(spark)))
    return reports.evaluation_report(spark, "now", totals, counts).select("line")


@register(
    "insight_context",
    f"""SELECT line FROM (VALUES ('Decisions by rule (today {DAY}):'), ('Top profiles:')) AS t(line)
        UNION ALL SELECT concat('- ', rule, ': {{''block'': ', count_if(act = 'block'), ', ''autocorrect'': ', count_if(act = 'autocorrect'),
            ', ''rpc_autocorrect_inplace'': ', count_if(act = 'rpc_autocorrect_inplace'), '}}') FROM {_DAY_LOG} GROUP BY rule
        UNION ALL SELECT * FROM (SELECT concat('- ', field, ': count=', n_writes, ' nulls=', n_nulls, ' sugg=', n_suggestions) FROM profiles
            ORDER BY field LIMIT 30)""",
)
def _(spark, sf_dir):
    day = D.of_day(V.decisions_log(spark, sf_dir), DAY)
    return reports.insight_context(spark, DAY, day, _profiles(spark, sf_dir)).select("line")


@register(
    "profile_summary",
    f"""SELECT line FROM (VALUES ('Top Missingness:'), (''), ('Format Issues:')) AS t(line)
        UNION ALL SELECT concat('- ', field, ': nulls=', nulls, ' count=', count) FROM ({_TOP_NULLS.format(n=5)})
        UNION ALL SELECT concat('- ', field, ': ', total, ' suggestions') FROM ({_TOP_ISSUES.format(n=5)})""",
)
def _(spark, sf_dir):
    table = materialize(_profiles(spark, sf_dir), "profiles")
    return reports.profile_summary(spark, table).select("line")


# -- streams ---------------------------------------------------------------------------------------------------------
@register("stream_decisions", "SELECT seq, action, rule_id FROM statement_decisions")
def _(spark, sf_dir):
    texts = streams.log_stream(spark, sf_dir).where(F.col("sql_text") != "").select("seq", "sql_text")
    found = jobs.stream_decisions(texts, V.rules(spark)).select("seq", "decision.action", "decision.rule_id")
    return streams.run_to_table(found)


@register(
    "stream_counters",
    """SELECT key, count(*) AS n FROM (SELECT concat('rule:', rule_id, ':', action) AS key FROM statement_decisions
        WHERE rule_id IS NOT NULL) GROUP BY key""",
)
def _(spark, sf_dir):
    log = correct.statement_decisions(streams.log_stream(spark, sf_dir), V.rules(spark))
    table = streams.run_to_table(jobs.stream_counters(log), "update")
    return streams.latest(table, "key")


@register("stream_threshold_gates", f"SELECT seq, rule_id, hits, min_hits, enforced FROM {_GATES}")
def _(spark, sf_dir):
    return streams.run_to_table(stateful.stream_gates(streams.decision_stream(spark, sf_dir), V.rules(spark)))


@register(
    "stream_reassembly",
    """SELECT seq % 2 AS conn_id, CASE WHEN starts_with(sql_text, 'dbo.') THEN 3 ELSE 1 END::BIGINT AS type,
        seq * 2 + 1 AS end_seq, seq % 1000 AS spid, sql_text AS text FROM query_log WHERE sql_text <> ''""",
)
def _(spark, sf_dir):
    found = streams.run_to_table(stateful.stream_messages(V.packets_of(streams.log_stream(spark, sf_dir))))
    return found.select("conn_id", big("type"), "end_seq", big("spid"), "text")


_CHANGE = "2024-01-16 00:00:00"


@register(
    "stream_decisions_as_of",
    f"""SELECT d.seq, d.action, CASE WHEN q.ts < TIMESTAMP '{_CHANGE}' THEN d.rule_id ELSE 'later-' || d.rule_id END AS rule_id
        FROM statement_decisions AS d JOIN query_log AS q ON q.seq = d.seq""",
)
def _(spark, sf_dir):
    """All rules get other names on one day; each statement meets those of its time."""
    at, never = F.lit(_CHANGE).cast("timestamp"), F.lit(None).cast("timestamp")
    rules = V.rules(spark)
    later = rules.withColumn("id", F.concat(F.lit("later-"), "id")).withColumns({"valid_from": at, "valid_to": never})
    versions = materialize(rules.withColumns({"valid_from": never, "valid_to": at}).unionByName(later), "rules")
    out, checkpoint = fresh_folder(spark, "decided"), fresh_folder(spark, "checkpoint")

    def sink(df: DataFrame, batch_id: int) -> None:
        df.select("seq", "decision.action", "decision.rule_id").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    texts = streams.log_stream(spark, sf_dir).where(F.col("sql_text") != "").select("seq", F.col("ts").cast("timestamp"), "sql_text")
    jobs.run_incremental(texts, jobs.decisions_of_their_time(lambda: versions, sink), checkpoint)
    return spark.read.parquet(out).drop("batch")


@register("stream_latency_p95", _quantile_sql())
def _(spark, sf_dir):
    stream = jobs.stream_quantile(streams.event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value")
    found = streams.latest(streams.run_to_table(stream, "update"), "window_start", "window_end")
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "count", F.round("quantile", 6).alias("quantile")
    )


@register(
    "stream_bytes_rate",
    """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS window_start, round(sum(length(props)) / 60.0, 6)::DOUBLE AS per_second
        FROM events GROUP BY 1""",
)
def _(spark, sf_dir):
    sizes = streams.event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.length("props").alias("size"))
    found = streams.latest(streams.run_to_table(jobs.stream_rate(sizes, "ts", "size"), "update"), "window_start")
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), F.round("per_second", 6).alias("per_second")
    )


@register("incremental_profiles", SQL_OF_PROFILES)
def _(spark, sf_dir):
    state, report = fresh_folder(spark, "state"), fresh_folder(spark, "reports")
    stream = streams.log_stream(spark, sf_dir).select("ts", "sql_text")
    jobs.run_incremental(stream, jobs.profile_batches(state, report, every=2), fresh_folder(spark, "checkpoint"))
    newest = jobs.profile_log(state, every=2).before(spark, streams.BATCHES)
    entries = F.transform(F.array_sort(F.map_entries("suggestions")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return newest.select("field", "count", "nulls", F.array_join(entries, ", ").alias("kinds"))


from checks import roundtrips  # noqa: E402, F401  registers the queries of sources and sinks
