"""Policy evaluation: ordered allow / block / autocorrect rules over events.

Rules are a table (see ``sources.rules.RULE_SCHEMA``); the first enabled rule that matches decides. Two forms give the
same result:

* ``compiled``: few rules become literals of one ``coalesce(when ...)`` expression; no join at all.
* ``join``: each predicate becomes a left join on its key with the first rule per key, so no event is multiplied. The
  rule side is broadcast when its measured size allows, else Spark shuffles both sides and splits skewed keys. Pattern
  rules are a substring test: a list of bounded length is tested in place, a longer one goes through an equi-join on
  pieces of the patterns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtgauge.functions.text import let, nonempty
from stmtgauge.operators.once import once
from stmtgauge.operators.small import BROADCAST_BYTES, broadcast_if_small, byte_size
from stmtgauge.sources.storage import materialize

COMPILED_LIMIT = 64
PATTERN_LIMIT = 4096
PATTERN_CHARS = 256 * 1024
#: Patterns in the first list that is tested, characters of each that the expression before it looks at.
FIRST_LIST, BEGINNING = 8, 8
#: Bytes of the pieces by which long lists of patterns meet texts: each pattern has pieces of the largest size that fits.
PIECES = (1, 2, 3, 6, 12)
#: Patterns of a long list that are tested in place first; patterns in the first blocks that go by pieces; so many short ones of
#: a size in a block are still tested one by one, which costs less than a look at each place of the texts.
LISTED, FIRST_BLOCKS, FEW = 32, (4096, 65536), 32
#: Bytes of a block of patterns as broadcast, and of a pattern in it besides its letters.
BLOCK_BYTES, SELECTOR_BYTES = 48 * 1024 * 1024, 96
#: Places of a text that are one array.
SPAN = 16384

# Verdict when no rule matches.
DEFAULT_ACTION, DEFAULT_REASON, DEFAULT_CONFIDENCE = "allow", "no matching rule", 1.0

MATCH_TYPE = "struct<ord:int,id:string,action:string,reason:string,confidence:double>"
DECISION_FIELDS = ("action", "reason", "confidence", "corrected_value", "rule_id")

# Allowed targets and actions.
TARGETS = ("table", "column", "pattern")
ACTIONS = ("allow", "block", "autocorrect")


def admit_rules(rules: DataFrame) -> DataFrame:
    """Keep rules with a known target and action (any letter case) and a selector."""
    return rules.where(
        F.lower("target").isin(*TARGETS)
        & F.lower("action").isin(*ACTIONS)
        & F.col("selector").isNotNull()
        & F.col("id").isNotNull()
    )


def active_rules(rules: DataFrame, env: str | None = None) -> DataFrame:
    """Enabled rules that apply in the environment; without an environment every rule applies."""
    gated = rules.where(F.coalesce(F.col("enabled"), F.lit(True)))
    name = (env or "").lower()
    if not name:
        return gated
    envs = F.transform("apply_in_envs", lambda e: F.lower(e))
    return gated.where(
        F.col("apply_in_envs").isNull() | (F.size("apply_in_envs") == 0) | F.array_contains(envs, name)
    )


def _match_struct() -> Column:
    return F.struct(
        F.col("ord").cast("int").alias("ord"),
        F.col("id"),
        F.col("action"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence"),
    )


def last_segment(column: Column) -> Column:
    """Last dotted part of a lower-case column name, leading at-signs removed."""
    return F.ltrim(F.substring_index(column, ".", -1), F.lit("@"))


@dataclass
class RuleSet:
    """Active rules prepared for matching. ``rows`` is set when they are few enough to compile, ``small`` when they may
    be broadcast."""

    rules: DataFrame
    rows: list | None
    small: bool = False

    @classmethod
    def prepare(cls, rules: DataFrame, env: str | None = None, form: str = "auto") -> RuleSet:
        active = active_rules(admit_rules(rules), env).select(
            _match_struct().alias("m"), F.col("target"), F.lower("selector").alias("selector")
        )
        if form not in ("auto", "compiled", "join"):
            raise ValueError(f"unknown form: {form}")
        rows = [] if form == "join" else active.limit(COMPILED_LIMIT + 1).collect()
        if form == "compiled" and len(rows) > COMPILED_LIMIT:
            raise ValueError(f"more than {COMPILED_LIMIT} active rules: use form='join'")
        if form == "join" or len(rows) > COMPILED_LIMIT:
            return cls(active, None, byte_size(active) <= BROADCAST_BYTES)
        return cls(active, sorted(rows, key=lambda r: r.m.ord))

    def of(self, target: str) -> DataFrame:
        return self.rules.where(F.col("target") == target)

    # -- matching: each adds a nullable MATCH_TYPE column ----------------------------------------------------------
    def match_table(self, df: DataFrame, table: Column, out: str) -> DataFrame:
        if self.rows is not None:
            key = F.col("__key")
            return self._compiled(df, {"__key": F.lower(nonempty(table))}, out, "table", lambda sel: key == sel)
        return self._lookup(df, F.lower(nonempty(table)), self.of("table"), F.col("selector"), out)

    def match_column(self, df: DataFrame, column: Column, out: str) -> DataFrame:
        """A dotted selector must equal the whole name, a bare one the last part of it."""
        full = F.lower(nonempty(column))
        if self.rows is not None:
            whole, last = F.col("__key"), F.col("__last")
            keys = {"__key": full, "__last": last_segment(full)}
            return self._compiled(
                df, keys, out, "column", lambda sel: whole == sel if "." in sel else last == sel.lstrip("@")
            )
        dotted = F.contains(F.col("selector"), F.lit("."))
        columns = self.of("column")
        df = self._lookup(df, full, columns.where(dotted), F.col("selector"), "__whole_match")
        bare = F.ltrim(F.col("selector"), F.lit("@"))
        df = self._lookup(df, last_segment(full), columns.where(~dotted), bare, "__last_match")
        return df.withColumn(out, F.least("__whole_match", "__last_match")).drop("__whole_match", "__last_match")

    def match_pattern(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        """Substring test on the text, any letter case. The form depends on the number of patterns, the answer does not."""
        low = F.lower(nonempty(text))
        if self.rows is not None:
            found = F.col("__key")
            return self._compiled(df, {"__key": low}, out, "pattern", lambda sel: F.contains(found, F.lit(sel)))
        patterns = self.of("pattern")
        n, chars = patterns.agg(F.count("*"), F.coalesce(F.sum(F.length("selector")), F.lit(0))).first()
        if n <= PATTERN_LIMIT and chars <= PATTERN_CHARS:
            return self._listed(df, low, self._in_order(patterns), out)
        if df.isStreaming:
            return self._listed_in_parts(df, low, patterns, out)
        return _match_by_pieces(df, low, patterns, out, self.small)

    @staticmethod
    def _in_order(patterns: DataFrame) -> list:
        return sorted(patterns.collect(), key=lambda r: r.m.ord)

    def _listed_in_parts(self, df: DataFrame, low: Column, patterns: DataFrame, out: str) -> DataFrame:
        """On a stream, which cannot meet the texts a second time: one constant list after the other, in order."""
        if not self.small:
            raise ValueError(f"pattern rules of more than {BROADCAST_BYTES} bytes on a stream: decide inside foreachBatch")
        parts, size = [[]], 0
        for r in self._in_order(patterns):
            if len(parts[-1]) >= PATTERN_LIMIT or (parts[-1] and size + len(r.selector) > PATTERN_CHARS):
                parts.append([])
                size = 0
            parts[-1].append(r)
            size += len(r.selector)
        names = [f"__part{i}" for i in range(len(parts))]
        for name, rows in zip(names, parts):
            df = self._listed(df, low, rows, name)
        return df.withColumn(out, F.coalesce(*names)).drop(*names)

    @staticmethod
    def _listed(df: DataFrame, low: Column, rows: list, out: str) -> DataFrame:
        """First of the listed patterns.

        One expression, factored by the beginnings of all patterns, tells texts apart that hold none of them. The others are
        tested against lists of doubling length until one has a hit. Lists are constant arrays, so the plan stays small.
        """
        text, firsts, at, size = F.col("__key"), [], 0, FIRST_LIST
        while at < len(rows):
            entries = json.dumps([{**r.m.asDict(), "selector": r.selector} for r in rows[at : at + size]])
            listed = F.from_json(F.lit(entries), f"array<{MATCH_TYPE[:-1]},selector:string>>")
            hits = F.filter(listed, lambda p: F.contains(text, p["selector"]))
            firsts.append(let(F.get(hits, F.lit(0)), lambda p: _fields_of(p)))
            at, size = at + size, 2 * size
        if not firsts:
            return df.withColumn(out, F.lit(None).cast(MATCH_TYPE))
        some = text.isNotNull()
        if all(r.selector for r in rows):
            some = some & text.rlike(beginnings([r.selector for r in rows]))
        return once(df.withColumn("__key", low), {out: F.when(some, F.coalesce(*firsts))}).drop("__key")

    def _compiled(self, df, keys, out, target, predicate) -> DataFrame:
        tests = [
            F.when(predicate(r.selector), _literal_match(r.m)) for r in self.rows if r.target == target
        ]
        if not tests:
            return df.withColumn(out, F.lit(None).cast(MATCH_TYPE))
        return once(df.withColumns(keys), {out: F.coalesce(*tests)}).drop(*keys)

    def _lookup(self, df: DataFrame, key: Column, rules: DataFrame, selector: Column, out: str) -> DataFrame:
        """Left join with the first rule per key: one match at most, so the number of rows stays."""
        first = rules.groupBy(selector.alias("__rule_key")).agg(F.min("m").alias(out))
        first = F.broadcast(first) if self.small else first
        return (
            df.withColumn("__key", key)
            .join(first, F.col("__key") == F.col("__rule_key"), "left")
            .drop("__key", "__rule_key")
        )


def beginnings(patterns: list[str], depth: int = BEGINNING) -> str:
    """An expression that finds the first ``depth`` characters of any of the patterns (none empty): the alternatives are the
    paths of a trie, so a place in a text is left as soon as no pattern goes on there."""
    trie: dict = {}
    for p in patterns:
        node = trie
        for i, c in enumerate(p[:depth]):
            if "" in node:  # a shorter pattern is found first
                break
            node = node.setdefault(c, {})
        else:
            node.clear()
            node[""] = {}

    def quoted(c: str) -> str:
        return c if c.isalnum() or not c.isascii() else f"\\x{ord(c):02x}"

    def written(node: dict) -> str:
        if "" in node:
            return ""
        ways = [quoted(c) + written(n) for c, n in sorted(node.items())]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return f"(?=[{''.join(quoted(c) for c in sorted(trie))}]){written(trie)}"


def _fields_of(p: Column) -> Column:
    names = ("ord", "id", "action", "reason", "confidence")
    return F.when(p.isNotNull(), F.struct(*[p[n].alias(n) for n in names]))


def _literal_match(m) -> Column:
    return F.struct(
        F.lit(m.ord).alias("ord"),
        F.lit(m.id).alias("id"),
        F.lit(m.action).alias("action"),
        F.lit(m.reason).alias("reason"),
        F.lit(m.confidence).alias("confidence"),
    ).cast(MATCH_TYPE)


def _match_by_pieces(df: DataFrame, low: Column, patterns: DataFrame, out: str, small: bool = False) -> DataFrame:
    """First pattern contained in the text, for rule lists too long to test one by one.

    Of equal selectors the first rule stands for all. Selectors meet the texts in the order of their rules, so a text is done
    with the first block that has one for it: a short list is tested in place, then blocks of selectors, each of a bounded
    size, find their texts by pieces. Only texts without a match go on. What is found is known by a digest of
    the text, so rows need no key.
    """
    selectors = _numbered(patterns)
    anything = selectors.where(F.length("selector") == 0).first()
    selectors = selectors.where(F.length("selector") > 0)
    spark = df.sparkSession
    # The pieces of a text cost far more than its bytes tell, so the partitions are not merged by their size.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.withColumn("__low", low).withColumn("__id", F.md5(F.col("__low").cast("binary")))
    listed = _first_listed(selectors)
    texts = once(keyed.where(F.col("__low").isNotNull()).select("__id", "__low"), {"__low": F.col("__low").cast("binary")})
    first = once(texts, {"n": _first_number(F.col("__low"), listed)})
    first = first.select("__id", "n", F.when(F.col("n").isNull(), F.col("__low")).alias("__low"))
    first = materialize(first.repartition(tasks).withColumn("__row", F.monotonically_increasing_id()), "texts")
    found = first.where(F.col("n").isNotNull()).select("__id", "n")
    texts = first.where(F.col("n").isNull()).drop("n")
    last = listed[-1].n if listed else -1
    left = texts.count()
    for start, end in _blocks(selectors.where(F.col("n") > last)):
        if not left:
            break
        by_pieces = _first_by_pieces(texts, selectors.where(F.col("n").between(start, end)))
        matched = materialize(by_pieces, "matches")
        found, done = found.unionByName(matched.select("__id", "n")), matched.count()
        # Texts are written again only when half of them are done, so all of that together is no more than they were.
        if 0 < left <= 2 * done:
            by_row = matched.select("__row").repartition(tasks, "__row")
            texts = materialize(texts.repartition(tasks, "__row").join(by_row, "__row", "left_anti"), "texts")
            left -= done
    first = found.groupBy("__id").agg(F.min("n").alias("n"))
    rules = selectors.select("n", F.col("m").alias(out))
    if small:
        rules = F.broadcast(rules)
    else:
        rules = broadcast_if_small(rules.join(first.select("n").distinct(), "n", "left_semi"), BROADCAST_BYTES)
    joined = keyed.join(first.join(rules, "n").drop("n"), "__id", "left").drop("__id", "__low")
    if anything is None:
        return joined
    return joined.withColumn(out, F.when(low.isNotNull(), F.least(F.col(out), _literal_match(anything.m))))


def _numbered(patterns: DataFrame) -> DataFrame:
    """(n, m, selector as bytes), written once so that the numbers hold: they go up in the order of the rules, and a minimum of
    numbers needs no sort of the matches."""
    total = patterns.agg(F.sum(F.octet_length("selector") + SELECTOR_BYTES)).first()[0] or 0
    # Equal selectors are one entry.
    selectors = patterns.groupBy("selector").agg(F.min("m").alias("m"))
    selectors = selectors.repartitionByRange(1 + 8 * total // BLOCK_BYTES, "m").sortWithinPartitions("m")
    n = F.monotonically_increasing_id().alias("n")
    return materialize(selectors.select(n, "m", F.col("selector").cast("binary").alias("selector")), "patterns")


def _first_listed(selectors: DataFrame) -> list:
    """The first selectors, as many as make a list of bounded length."""
    sizes = selectors.select("n", F.octet_length("selector").alias("size")).orderBy("n").limit(LISTED).collect()
    last, size = -1, 0
    for r in sizes:
        size += r["size"]
        if size > PATTERN_CHARS:
            break
        last = r.n
    return sorted(selectors.where(F.col("n") <= last).select("n", "selector").collect(), key=lambda r: r.n)


def _first_number(text: Column, rows: list) -> Column:
    """Number of the first listed selector in the bytes of a text: no selector behind the first hit is tested."""
    tests = [F.when(F.contains(text, F.lit(bytes(r.selector))), F.lit(r.n).cast("bigint")) for r in rows]
    return F.coalesce(F.lit(None).cast("bigint"), *tests)


def _blocks(selectors: DataFrame) -> list[tuple[int, int]]:
    """Ranges of numbers that cut the selectors into blocks: short ones first, as most texts are done with those, and none of
    more than about ``BLOCK_BYTES``."""
    part = F.shiftright("n", 33)  # numbers go on inside a written part only
    size = F.sum(F.octet_length("selector") + SELECTOR_BYTES).alias("size")
    parts = selectors.groupBy(part.alias("part")).agg(F.min("n").alias("start"), F.max("n").alias("end"), size).orderBy("part")
    blocks, lengths, begun, rows, room = [], list(FIRST_BLOCKS), None, 0, BLOCK_BYTES
    for r in parts.collect():
        at, each = r.start, r["size"] / (r.end - r.start + 1)
        while at <= r.end:
            begun = at if begun is None else begun
            most = min(lengths[0] - rows, int(room / each)) if lengths else int(room / each)
            take = min(r.end - at + 1, max(most, 0 if rows else 1))
            at, rows, room = at + take, rows + take, room - take * each
            if at <= r.end:  # the block is full
                blocks.append((begun, at - 1))
                lengths, begun, rows, room = lengths[1:], None, 0, BLOCK_BYTES
    return [*blocks, (begun, r.end)] if begun is not None else blocks


def _windows(df: DataFrame, text: str, size: int) -> DataFrame:
    """A row per place ``at`` (from 1) in the text where ``size`` bytes begin; a long text is not one long array."""
    ends = F.octet_length(text) - size + 1
    spans = df.where(F.octet_length(text) >= size).withColumn("__from", F.explode(F.sequence(F.lit(1), ends, F.lit(SPAN))))
    upto = F.least(F.col("__from") + (SPAN - 1), ends)
    return spans.withColumn("at", F.explode(F.sequence("__from", upto))).drop("__from")


def _filed(selectors: DataFrame, size: int) -> DataFrame:
    """Each selector under the piece of ``size`` bytes which it shares with the fewest others: (key, place, n, selector)."""
    piece = F.substring("selector", F.col("at"), F.lit(size)).alias("piece")
    pieces = _windows(selectors.select("n", "selector"), "selector", size).select("n", "at", piece)
    often = pieces.groupBy("piece").agg(F.count("*").alias("often"))
    rarest = F.min_by(F.struct("piece", F.col("at").alias("place")), F.struct("often", "piece", "at")).alias("rarest")
    placed = pieces.join(often, "piece").groupBy("n").agg(rarest)
    return selectors.select("n", "selector").join(placed, "n").select(
        F.xxhash64("rarest.piece").alias("key"), "rarest.place", "n", "selector"
    )


def _first_by_pieces(texts: DataFrame, selectors: DataFrame) -> DataFrame:
    """(__row, __id, n) of the texts that contain any of a block of selectors, few enough to be broadcast.

    A text that contains a selector contains each piece of it: every selector is filed under one piece, of the largest of the
    sizes in ``PIECES`` that fits, and each place of a text looks up the piece that begins there. All is bytes, of which any
    place in a text is at hand, and a selector found is compared right there: texts are read in place, neither cut into lists
    of pieces nor repeated.
    """
    fits = F.coalesce(*[F.when(F.octet_length("selector") >= n, F.lit(n)) for n in reversed(PIECES)])
    selectors = selectors.withColumn("size", fits)
    counts = {r["size"]: r["count"] for r in selectors.groupBy("size").count().collect()}
    few = [size for size, n in counts.items() if n <= FEW and size < PIECES[-1]]
    rows = sorted(selectors.where(F.col("size").isin(few)).select("n", "selector").collect(), key=lambda r: r.n) if few else []
    matched = once(texts.select("__row", "__id", "__low"), {"n": _first_number(F.col("__low"), rows)})
    matched = matched.where(F.col("n").isNotNull()).select("__row", "__id", "n")
    for size in sorted(counts.keys() - set(few)):
        filed = F.broadcast(_filed(selectors.where(F.col("size") == size), size))
        key = F.xxhash64(F.substring("__low", F.col("at"), F.lit(size)))
        begins = F.col("at") - F.col("place") + 1
        there = F.substring("__low", begins, F.octet_length("selector")) == F.col("selector")
        met = _windows(texts, "__low", size).join(filed, (key == F.col("key")) & (begins > 0) & there)
        matched = matched.unionByName(met.groupBy("__row", "__id").agg(F.min("n").alias("n")))
    return matched.groupBy("__row", "__id").agg(F.min("n").alias("n"))


def decision_of(*matches: str) -> Column:
    """Decision struct from match columns: the match with the lowest position wins, else the default."""
    m = F.least(*[F.col(c) for c in matches]) if len(matches) > 1 else F.col(matches[0])
    default = F.struct(
        F.lit(DEFAULT_ACTION), F.lit(DEFAULT_REASON), F.lit(DEFAULT_CONFIDENCE), F.lit(None).cast("string"),
        F.lit(None).cast("string"),
    )
    found = F.struct(m["action"], m["reason"], m["confidence"], F.lit(None).cast("string"), m["id"])
    kind = "struct<action:string,reason:string,confidence:double,corrected_value:string,rule_id:string>"
    return F.when(m.isNotNull(), found.cast(kind)).otherwise(default.cast(kind))


def decide(events: DataFrame, rules: DataFrame, env: str | None = None, form: str = "auto") -> DataFrame:
    """Add ``decision`` to events with columns ``sql_text``, ``table`` and ``column`` (absent ones count as NULL)."""
    ruleset = RuleSet.prepare(rules, env, form)
    matches = []
    df = events
    if "table" in events.columns:
        df = ruleset.match_table(df, F.col("table"), "__by_table")
        matches.append("__by_table")
    if "column" in events.columns:
        df = ruleset.match_column(df, F.col("column"), "__by_column")
        matches.append("__by_column")
    if "sql_text" in events.columns:
        df = ruleset.match_pattern(df, F.col("sql_text"), "__by_pattern")
        matches.append("__by_pattern")
    if not matches:
        raise ValueError("events need at least one of the columns table, column, sql_text")
    return df.withColumn("decision", decision_of(*matches)).drop(*matches)


def decide_as_of(events: DataFrame, rules: DataFrame, ts: str = "ts", env: str | None = None, form: str = "auto") -> DataFrame:
    """As :func:`decide`, by the rules in force at the time of each event.

    Rules have ``valid_from`` (inclusive) and ``valid_to`` (exclusive); NULL is open. Up to ``COMPILED_LIMIT`` versions of rules
    are one expression with their times in it. More are decided by span between two changes of the rules, each with those
    in force then. Events without a time are decided by the rules that are always in force.
    """
    bounds = ("valid_from", "valid_to")
    admitted = active_rules(admit_rules(rules), env)
    if form != "join" and admitted.limit(COMPILED_LIMIT + 1).count() <= COMPILED_LIMIT:
        rows = admitted.select(
            _match_struct().alias("m"), F.lower("target").alias("target"), F.lower("selector").alias("selector"), *bounds
        ).collect()
        return _compiled_as_of(events, sorted(rows, key=lambda r: r.m.ord), ts)
    changes = admitted.select(F.explode(F.array(*bounds)).alias("at")).where("at IS NOT NULL").distinct()
    points = sorted(r["at"] for r in changes.collect())  # a point per change of the rules
    out = None
    for low, high in zip([None, *points], [*points, None]):
        there = F.lit(True) if low is None else F.col(ts) >= F.lit(low)
        there = there if high is None else there & (F.col(ts) < F.lit(high))
        begun = F.col("valid_from").isNull() if low is None else F.col("valid_from").isNull() | (F.col("valid_from") <= F.lit(low))
        open_ = F.col("valid_to").isNull() if high is None else F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(high))
        part = decide(events.where(there), rules.where(begun & open_).drop(*bounds), env, form)
        out = part if out is None else out.unionByName(part)
    if points:
        always = rules.where(F.col("valid_from").isNull() & F.col("valid_to").isNull()).drop(*bounds)
        out = out.unionByName(decide(events.where(F.col(ts).isNull()), always, env, form))
    return out


def _compiled_as_of(events: DataFrame, rows: list, ts: str) -> DataFrame:
    low = lambda c: F.lower(nonempty(F.col(c))) if c in events.columns else F.lit(None).cast("string")
    keys = {"__table": low("table"), "__column": low("column"), "__last": last_segment(low("column")), "__text": low("sql_text")}
    tests = []
    for r in rows:
        if r.target == "column":
            hit = F.col("__column") == r.selector if "." in r.selector else F.col("__last") == r.selector.lstrip("@")
        else:
            hit = F.col("__table") == r.selector if r.target == "table" else F.contains(F.col("__text"), F.lit(r.selector))
        if r.valid_from is not None:
            hit = hit & (F.col(ts) >= F.lit(r.valid_from))
        if r.valid_to is not None:
            hit = hit & (F.col(ts) < F.lit(r.valid_to))
        tests.append(F.when(hit, _literal_match(r.m)))
    found = F.coalesce(*tests) if tests else F.lit(None).cast(MATCH_TYPE)
    matched = once(events.withColumns(keys), {"__match": found})
    return matched.withColumn("decision", decision_of("__match")).drop(*keys, "__match")


def rule_index(rules: DataFrame) -> DataFrame:
    """One row per rule id; of duplicates the last one in order."""
    return rules.groupBy("id").agg(F.max_by(F.struct(*[c for c in rules.columns if c != "id"]), "ord").alias("rule"))


def lookup_rules(df: DataFrame, rules: DataFrame, rule_id: str = "rule_id") -> DataFrame:
    """Add ``rule``: the rule with the given id, NULL when there is none."""
    index = broadcast_if_small(rule_index(rules).withColumnRenamed("id", "__id"))
    return df.join(index, F.col(rule_id) == F.col("__id"), "left").drop("__id")


def validate_rules(rules: DataFrame) -> DataFrame:
    """(ord, error) for every defective rule: the first failing check, then ids seen before on a sound rule.

    ``rules`` holds raw text fields: ``id, target, selector, action, reason, confidence, enabled, apply_in_envs,
    min_hits_to_enforce`` as JSON values (strings with their quotes), NULL when absent.
    """
    raw = lambda name: F.col(name)
    present = lambda name: raw(name).isNotNull()
    text = lambda name: present(name) & raw(name).startswith('"')
    filled = lambda name: text(name) & (raw(name) != '""')
    among = lambda name, values: present(name) & raw(name).isin(*[f'"{v}"' for v in values])
    given = lambda name: present(name) & (raw(name) != "null")
    number = lambda name: raw(name).try_cast("double")
    whole = lambda name: raw(name).rlike(r"^-?\d+$")
    boolean = lambda name: raw(name).isin("true", "false")
    kind = lambda name: F.schema_of_variant(F.try_parse_json(raw(name)))
    list_of_strings = lambda name: kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>")

    # Messages, with the allowed values in alphabetic order.
    checks = [
        (filled("id"), "id must be a non-empty string"),
        (among("target", TARGETS), "target must be one of ['column', 'pattern', 'table']"),
        (filled("selector"), "selector must be a non-empty string"),
        (among("action", ACTIONS), "action must be one of ['allow', 'autocorrect', 'block']"),
        (~given("reason") | text("reason"), "reason must be a string if provided"),
        (
            ~present("confidence")
            | boolean("confidence")
            | (~text("confidence") & number("confidence").between(0.0, 1.0)),
            "confidence must be a number between 0 and 1",
        ),
        (~present("enabled") | boolean("enabled"), "enabled must be boolean if provided"),
        (~given("apply_in_envs") | list_of_strings("apply_in_envs"), "apply_in_envs must be a list of strings"),
        (
            ~present("min_hits_to_enforce")
            | boolean("min_hits_to_enforce")
            | (whole("min_hits_to_enforce") & ~raw("min_hits_to_enforce").startswith("-"))
            | (raw("min_hits_to_enforce") == "-0"),
            "min_hits_to_enforce must be a non-negative integer",
        ),
    ]
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in checks])
    checked = rules.select("ord", "id", error.alias("error"))
    sound = checked.where(F.col("error").isNull())
    # Only ids that repeat meet the rules again, so a frequent id costs one aggregated row.
    repeated = sound.groupBy("id").agg(F.min("ord").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    duplicates = sound.join(repeated.select("id", "__first"), "id").where(F.col("ord") > F.col("__first"))
    return checked.where(F.col("error").isNotNull()).select("ord", "error").unionByName(
        duplicates.select("ord", F.concat(F.lit("duplicate id: "), F.btrim("id", F.lit('"'))).alias("error"))
    )


def snapshot_diff(current: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    """(key, change, current, proposed): rows added, removed or changed between two versions of a keyed table."""
    fields = [c for c in current.columns if c != key]
    old = current.select(key, F.struct(*fields).alias("current"))
    new = proposed.select(key, F.struct(*fields).alias("proposed"))
    joined = old.join(new, key, "full_outer")
    change = (
        F.when(F.col("current").isNull(), F.lit("added"))
        .when(F.col("proposed").isNull(), F.lit("removed"))
        .when(~F.col("current").eqNullSafe(F.col("proposed")), F.lit("changed"))
    )
    return joined.withColumn("change", change).where(F.col("change").isNotNull()).select(
        key, "change", "current", "proposed"
    )


def suggest_rules(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``suggested``: a rule guessed from a request in plain words."""
    low = F.lower(F.col(text_col))
    has = lambda *words: F.array_contains(F.array(*[F.contains(low, F.lit(w)) for w in words]), True)
    # Trigger words and the three suggestions.
    suggestions = {
        "email": ("no-null-email", "column", "Email", "block", "Email required", 0.9),
        "phone": ("phone-autocorrect", "column", "Phone", "autocorrect", "Normalize phone format", 0.8),
        "other": ("suggest-1", "pattern", "INSERT INTO", "block", "Suggested from natural language", 0.7),
    }

    def rule(name: str) -> Column:
        rid, target, selector, action, reason, confidence = suggestions[name]
        clean = F.left(F.regexp_replace(F.lit(rid), r"[^a-z0-9\-]", "-"), F.lit(64))
        return F.struct(
            clean.alias("id"),
            F.lit(target).alias("target"),
            F.lit(selector).alias("selector"),
            F.lit(action).alias("action"),
            F.lit(reason).alias("reason"),
            F.lit(confidence).alias("confidence"),
            F.lit(True).alias("enabled"),
        )

    wants_email = has("email") & has("require", "krav", "måste", "must")
    return df.withColumn(
        "suggested",
        F.when(wants_email, rule("email")).when(has("phone", "telefon"), rule("phone")).otherwise(rule("other")),
    )
