"""Rule matching: stated cases, all forms against a plain loop, validation, diff, suggestions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stmtgauge.operators import policy
from stmtgauge.sources.rules import RULE_SCHEMA


def rule(n, rid, target, selector, action="block", enabled=True, envs=None, hits=0):
    return (n, rid, target, selector, action, f"because {rid}", 0.5, enabled, envs, hits)


def events(spark, rows):
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)], "seq BIGINT, sql_text STRING, table STRING, column STRING, value STRING"
    )


def plain_decide(rules, env, sql, table, column):
    """First rule in order that is switched on, applies here and matches."""
    for _, rid, target, selector, action, reason, confidence, enabled, envs, _ in sorted(rules):
        if not enabled or (envs and env and env.lower() not in [e.lower() for e in envs]):
            continue
        wanted, hit = selector.lower(), False
        if target == "table":
            hit = bool(table) and table.lower() == wanted
        elif target == "column" and column:
            name = column.lower()
            hit = name == wanted if "." in wanted else name.rpartition(".")[2].lstrip("@") == wanted.lstrip("@")
        elif target == "pattern":
            hit = bool(sql) and wanted in sql.lower()
        if hit:
            return action, reason, confidence, rid
    return "allow", "no matching rule", 1.0, None


def decisions(df):
    return {r.seq: (r.decision.action, r.decision.reason, r.decision.confidence, r.decision.rule_id) for r in df.collect()}


def test_stated_cases(spark):
    rules = [
        rule(0, "off", "pattern", "select", enabled=False),
        rule(1, "dev-only", "column", "secret", envs=["Dev"]),
        rule(2, "full", "column", "dbo.Users.Email"),
        rule(3, "bare", "column", "Phone", "autocorrect"),
        rule(4, "param", "column", "@Id"),
        rule(5, "table", "table", "DBO.T"),
        rule(6, "text", "pattern", "Insert Into x"),
        rule(7, "odd-case", "Column", "other"),
    ]
    rows = [
        ("select 1", None, None, None),
        (None, None, "dbo.a.Secret", None),
        (None, None, "DBO.users.email", None),
        (None, None, "x.Email", None),
        (None, "dbo.t", "dbo.t.phone", None),
        (None, None, "@id", None),
        ("-- INSERT INTO X", "dbo.T", None, None),
        ("insert into x", "", "", None),
        (None, None, "other", None),
    ]
    frame, table = events(spark, rows), spark.createDataFrame(rules, RULE_SCHEMA)
    for env in (None, "dev", "prod"):
        expected = {i: plain_decide(rules, env, *row[:3]) for i, row in enumerate(rows)}
        for form in ("compiled", "join"):
            assert decisions(policy.decide(frame, table, env, form)) == expected, (env, form)
    assert decisions(policy.decide(frame, table))[4][3] == "bare"


def random_case(rng, n_rules, n_events):
    words = ["a", "B", "ab", "b.a", "@a", "x.y.B", "", "A@b", "long text with B", "ÅB"]
    pick = lambda: rng.choice(words)
    rules = [
        rule(i, f"r{i}", rng.choice(["table", "column", "pattern"]), pick() + rng.choice(["", "z", "q"]), rng.choice(["allow", "block", "autocorrect"]),
             rng.random() < 0.8, rng.choice([None, [], ["p"], ["P", "q"]]))
        for i in range(n_rules)
    ]
    some = lambda: None if rng.random() < 0.2 else pick() + rng.choice(["", "z", "Q", "zq"])
    return rules, [(some(), some(), some(), some()) for _ in range(n_events)]


@pytest.mark.parametrize("seed", range(3))
def test_forms_match_the_plain_loop(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rules, rows = random_case(rng, 30, 300)
    frame, table = events(spark, rows), spark.createDataFrame(rng.sample(rules, len(rules)), RULE_SCHEMA)
    expected = {i: plain_decide(rules, "p", *row[:3]) for i, row in enumerate(rows)}
    assert decisions(policy.decide(frame, table, "p", "compiled")) == expected
    assert decisions(policy.decide(frame, table, "p", "join")) == expected
    # Beyond the list limit patterns go through pieces; beyond the broadcast limit lookups are shuffled.
    monkeypatch.setattr(policy, "PATTERN_LIMIT", 2)
    monkeypatch.setattr(policy, "BROADCAST_BYTES", 0)
    assert decisions(policy.decide(frame, table, "p", "join")) == expected


@pytest.mark.parametrize("limit", [4096, 100])
def test_many_patterns(spark, monkeypatch, limit):
    monkeypatch.setattr(policy, "PATTERN_LIMIT", limit)
    rng = random.Random(9)
    letters = "abcÅ d"
    rules = [rule(i, f"r{i}", "pattern", "".join(rng.choice(letters) for _ in range(rng.randint(3, 6)))) for i in range(400)]
    rows = [("".join(rng.choice(letters) for _ in range(rng.randint(0, 25))).upper(), None, None, None) for _ in range(300)]
    got = decisions(policy.decide(events(spark, rows).drop("table", "column"), spark.createDataFrame(rules, RULE_SCHEMA)))
    assert got == {i: plain_decide(rules, None, row[0], None, None) for i, row in enumerate(rows)}


def test_joins_keep_events_and_broadcast_only_small_sides(spark, monkeypatch):
    rules = spark.createDataFrame([rule(i, f"r{i}", "column", f"c{i}") for i in range(100)], RULE_SCHEMA)
    frame = events(spark, [("s", "t", "c1", None)])
    plan = lambda: policy.decide(frame, rules)._jdf.queryExecution().executedPlan().toString()
    text = plan()
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Cartesian" not in text
    monkeypatch.setattr(policy, "BROADCAST_BYTES", 0)
    text = plan()
    assert "BroadcastHashJoin" not in text and "NestedLoop" not in text and "SortMergeJoin" in text


def test_compiled_form_is_bounded(spark):
    rules = spark.createDataFrame([rule(i, f"r{i}", "column", f"c{i}") for i in range(100)], RULE_SCHEMA)
    with pytest.raises(ValueError):
        policy.decide(events(spark, [("s", "t", "c1", None)]), rules, form="compiled")


def test_admission_and_lookup(spark):
    rules = [
        rule(0, "ok", "TABLE", "x", "Block"), rule(1, "bad-target", "row", "x"), rule(2, "bad-action", "table", "x", "warn"),
        rule(3, "no-selector", "table", None), rule(4, "ok", "table", "y"),
    ]
    table = spark.createDataFrame(rules, RULE_SCHEMA)
    assert [r.ord for r in policy.admit_rules(table).orderBy("ord").collect()] == [0, 4]
    ids = spark.createDataFrame([("ok",), ("gone",), (None,)], "rule_id STRING")
    found = {r.rule_id: r.rule and r.rule.selector for r in policy.lookup_rules(ids, table).collect()}
    assert found == {"ok": "y", "gone": None, None: None}


def test_validation(spark):
    fields = "ord INT, id STRING, target STRING, selector STRING, action STRING, reason STRING, confidence STRING, enabled STRING, apply_in_envs STRING, min_hits_to_enforce STRING"  # noqa: E501
    good = ('"a"', '"table"', '"x"', '"allow"', None, None, None, None, None)

    def but(**changes):
        names = [f.split()[0] for f in fields.split(", ")][1:]
        return tuple(changes.get(n, v) for n, v in zip(names, good))

    raw = [
        good, but(id=None), but(id='"b"', target='"Table"'), but(id='"c"', selector='""'), but(id='"d"', action="7"), good,
        but(id='"e"', reason="1"), but(id='"f"', confidence="1.01"), but(id='"g"', enabled='"yes"'),
        but(id='"h"', apply_in_envs='["x",1]'), but(id='"i"', min_hits_to_enforce="-1"), but(id='"j"', confidence="true", reason="null"),
        but(id=None, target=None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(raw)], fields)
    errors = {r.ord: r.error.split(" ")[0] for r in policy.validate_rules(df).collect()}
    assert errors == {
        1: "id", 2: "target", 3: "selector", 4: "action", 5: "duplicate", 6: "reason", 7: "confidence", 8: "enabled",
        9: "apply_in_envs", 10: "min_hits_to_enforce", 12: "id",
    }


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("c", "3", "x")], "id STRING, v STRING, w STRING")
    new = spark.createDataFrame([("a", "1", None), ("b", "9", None), ("d", "4", None)], "id STRING, v STRING, w STRING")
    assert {r.id: r.change for r in policy.snapshot_diff(old, new, "id").collect()} == {"b": "changed", "c": "removed", "d": "added"}


def test_suggestions(spark):
    texts = [("Normalize PHONE numbers",), ("email must be set",), ("Krav: email och telefon",), ("email only",), ("Måste ha Email",)]
    got = {r.t: r.suggested.id for r in policy.suggest_rules(spark.createDataFrame(texts, "t STRING"), "t").collect()}
    assert list(got.values()) == ["phone-autocorrect", "no-null-email", "no-null-email", "suggest-1", "no-null-email"]
    one = policy.suggest_rules(spark.createDataFrame(texts[:1], "t STRING"), "t").select(F.col("suggested.*")).first()
    assert (one.target, one.selector, one.action, one.enabled) == ("column", "Phone", "autocorrect", True)


@pytest.mark.parametrize("limit", [4096, 2])
def test_rows_without_a_key_and_short_selectors(spark, monkeypatch, limit):
    """Equal or null seq, selectors of one and two letters: the same answers whatever form is taken."""
    monkeypatch.setattr(policy, "COMPILED_LIMIT", 1)
    monkeypatch.setattr(policy, "PATTERN_LIMIT", limit)
    selectors = ["drop table", "q", "xy", "drop", "", None][: 5 if limit == 4096 else 6]
    rules = [rule(i, f"r{i}", "pattern", s) for i, s in enumerate(selectors) if s != ""]
    texts = ["DROP table a", "plain", "Q", "no xY here", "drop it", "plain", None, ""]
    frame = spark.createDataFrame([(None if i % 3 else 1, t) for i, t in enumerate(texts)], "seq BIGINT, sql_text STRING")
    got = [(r.sql_text, r.decision.rule_id) for r in policy.decide(frame, spark.createDataFrame(rules, RULE_SCHEMA)).collect()]
    want = [("DROP table a", "r0"), ("plain", None), ("Q", "r1"), ("no xY here", "r2"), ("drop it", "r3"), ("plain", None), (None, None), ("", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_null_selector_decides_nothing(spark):
    rules = [rule(0, "none", "column", None), rule(1, "bad", "row", "x"), rule(2, "c", "column", "c")]
    frame = events(spark, [(None, None, "c", None)])
    for more in (0, 100):
        many = rules + [rule(3 + i, f"u{i}", "column", None if i % 2 else f"unused{i}") for i in range(more)]
        got = policy.decide(frame, spark.createDataFrame(many, RULE_SCHEMA)).collect()
        assert [r.decision.rule_id for r in got] == ["c"]


def test_stream_with_more_patterns_than_a_list_holds(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(policy, "COMPILED_LIMIT", 1)
    monkeypatch.setattr(policy, "PATTERN_LIMIT", 2)
    rules = spark.createDataFrame([rule(i, f"r{i}", "pattern", f"word{i} ") for i in range(7)], RULE_SCHEMA)
    spark.createDataFrame([("a word5 word3 b",), ("word9",), (None,)], "sql_text STRING").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sql_text STRING").parquet(str(tmp_path / "in"))
    decided = policy.decide(stream, rules).select("sql_text", "decision.rule_id")
    query = decided.writeStream.format("memory").queryName("many_patterns").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    got = {r.sql_text: r.rule_id for r in spark.table("many_patterns").collect()}
    assert got == {"a word5 word3 b": "r3", "word9": None, None: None}


def test_list_of_strings_is_parsed(spark):
    given = ['["a\\"b"]', "[]", '["x", "y"]', '"x"', "[1]", '["x", 1]', '{"a": 1}', "null"]
    fields = "ord INT, id STRING, target STRING, selector STRING, action STRING, reason STRING, confidence STRING, enabled STRING, apply_in_envs STRING, min_hits_to_enforce STRING"
    rows = [(i, f'"r{i}"', '"column"', '"c"', '"block"', None, None, None, e, None) for i, e in enumerate(given)]
    bad = {r.ord for r in policy.validate_rules(spark.createDataFrame(rows, fields)).collect()}
    assert bad == {3, 4, 5, 6}


def test_beginnings_find_what_some_pattern_begins_with(spark):
    draw = random.Random(11)
    letters = "ab.*[\\^-]$ é漢🙂\n'"
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    for depth in (1, 3, 8):
        patterns = [word(draw.randint(1, 12)) for _ in range(60)]
        texts = [(word(draw.randint(0, 14)),) for _ in range(400)] + [(p,) for p in patterns] + [(None,)]
        found = policy.beginnings(patterns, depth)
        for r in spark.createDataFrame(texts, "t STRING").select("t", F.col("t").rlike(found).alias("hit")).collect():
            assert r.hit == (None if r.t is None else any(p[:depth] in r.t for p in patterns))


def test_the_first_of_many_listed_patterns(spark):
    draw = random.Random(12)
    word = lambda n: "".join(draw.choice("abcd") for _ in range(n))
    selectors = [word(draw.randint(3, 6)) for _ in range(300)]
    rules = [(i, f"r{i}", "pattern", s, "block", "", 1.0, True, None, 0) for i, s in enumerate(selectors)]
    texts = [(i, word(draw.randint(0, 9))) for i in range(500)]
    df = spark.createDataFrame(texts, "seq BIGINT, sql_text STRING")
    got = {r.seq: r.rule_id for r in policy.decide(df, spark.createDataFrame(rules, RULE_SCHEMA)).select("seq", "decision.rule_id").collect()}
    want = {i: next((f"r{k}" for k, s in enumerate(selectors) if s in t), None) for i, t in texts}
    assert got == want and len(set(want.values())) > 20


@pytest.mark.parametrize("form", ["auto", "join"])
def test_rules_of_their_time(spark, form):
    import datetime

    draw, day = random.Random(13), lambda n: None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    selectors = {"pattern": ["select", "from", "x"], "table": ["T", "u"], "column": ["t.a", "B", "@c"]}
    rules = []
    for i in range(14):
        target = draw.choice(list(selectors))
        start, end = draw.choice([(None, None), (None, 5), (3, None), (2, 6), (5, 8), (6, 6)])
        rules.append((*rule(i, f"r{i}", target, draw.choice(selectors[target])), day(start), day(end)))
    rows = [(i, day(draw.choice([None, 0, 2, 3, 5, 6, 7, 9])), draw.choice(["SELECT 1", "from x", "zz", None]), draw.choice(["t", "U", None]), draw.choice(["t.a", "q.b", "C", None])) for i in range(300)]
    events_ = spark.createDataFrame(rows, "seq BIGINT, ts TIMESTAMP, sql_text STRING, table STRING, column STRING")
    given = spark.createDataFrame(rules, f"{RULE_SCHEMA}, valid_from TIMESTAMP, valid_to TIMESTAMP")
    got = {r.seq: r.rule_id for r in policy.decide_as_of(events_, given, form=form).select("seq", "decision.rule_id").collect()}
    want = {}
    for t in {r[1] for r in rows}:
        there = lambda r: (r[-2] is None or t is not None and t >= r[-2]) and (r[-1] is None or t is not None and t < r[-1])  # noqa: E731, B023
        now = spark.createDataFrame([r[:-2] for r in rules if there(r)], RULE_SCHEMA)
        some = spark.createDataFrame([r for r in rows if r[1] == t], events_.schema)
        want |= {r.seq: r.rule_id for r in policy.decide(some, now, form="compiled").select("seq", "decision.rule_id").collect()}
    assert got == want and len(set(want.values())) > 5


def test_selectors_that_are_pieces_need_no_test_of_the_texts(spark, monkeypatch):
    """Selectors that share their letters with each other but are pieces themselves meet only texts that hold them."""
    monkeypatch.setattr(policy, "PATTERN_LIMIT", 2)
    selectors = ["abc" + format(i, "03d") for i in range(40)] + ["abc000", "?bc😀de", "😀"]
    rules = [rule(i, f"r{i}", "pattern", s) for i, s in enumerate(selectors)]
    texts = ["xABC039abc007", "abc", "a😀bc😀dex", "?BC😀DE", "ab😀", "", None]
    table = spark.createDataFrame(rules, RULE_SCHEMA)
    decided = policy.decide(spark.createDataFrame([(t,) for t in texts], "sql_text STRING"), table, form="join")
    assert "Contains(" not in decided._jdf.queryExecution().executedPlan().toString()
    got = {r.sql_text: r.decision.rule_id for r in decided.collect()}
    assert got == {t: plain_decide(rules, None, t, None, None)[-1] if t else None for t in texts}


@pytest.mark.parametrize("few", [0, 32])
def test_long_lists_go_block_by_block(spark, monkeypatch, few):
    """Texts are done with the first block that has a rule for them, whatever their length and the length of the selectors."""
    for name, value in {"PATTERN_LIMIT": 2, "LISTED": 3, "FIRST_BLOCKS": (2, 5), "FEW": few, "BLOCK_BYTES": 3000, "SPAN": 4}.items():
        monkeypatch.setattr(policy, name, value)
    monkeypatch.setattr(policy, "BROADCAST_BYTES", 0)
    written, materialize = [], policy.materialize

    def spy(df, purpose="table"):
        table = materialize(df, purpose)
        if purpose == "texts":
            written.append(sorted(bytes(r["__low"]).decode() for r in table.where("__low IS NOT NULL").collect()))
        return table

    monkeypatch.setattr(policy, "materialize", spy)
    rng = random.Random(4)
    word = lambda low, high, letters="abé😀": "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    selectors = ["zz1", "zz2", "zz3", *("same beginnings " + word(1, 4) for _ in range(12)), *(word(3, 9) for _ in range(60))]
    texts = [word(0, 30, "abé😀 ").upper() for _ in range(60)] + ["x SAME BEGINNINGS " + word(0, 9) for _ in range(20)]
    texts += ["zz3" * 9, "ZZ2 and zz1", "same beginnings", "nothing", "nothing", "", None, "é" * 50 + "b" + "é" * 50]
    rules = [rule(i, f"r{i}", "pattern", s) for i, s in enumerate(selectors)]
    table = spark.createDataFrame(rules[::-1], RULE_SCHEMA)
    decided = policy.decide(spark.createDataFrame([(t,) for t in texts], "sql_text STRING"), table, form="join").collect()
    want = {t: plain_decide(rules, None, t, None, None)[-1] if t else None for t in texts}
    assert len(decided) == len(texts) and {r.sql_text: r.decision.rule_id for r in decided} == want
    assert len(set(want.values())) > 10
    ranks = sorted((int(r[1:]) if (r := want[t]) else 999, t.lower()) for t in texts if t)
    assert written[0] == sorted(t for rank, t in ranks if rank > 2)
    assert all(set(later) <= set(earlier) for earlier, later in zip(written, written[1:]))
