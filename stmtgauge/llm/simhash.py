"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints that differ in at most three of 64 bits agree in one of four 16-bit blocks at least. Each distinct
fingerprint is filed once per block under (block, its value); that value is the top node of the index, met exactly.
Within a partition the fingerprints are sorted by node and then by the Gray rank of the remaining bits, and runs of eight
form the next nodes, eight of those the nodes above, and so on. A node keeps the bits that all below it share (a mask and
a pattern). Two nodes are compared by their shared bits first: differences add up on the way down, and whole groups go as
soon as more than three have accumulated. Groups that are known to be connected already are not compared any further, so
that a dense group of near copies costs about as many comparisons as it has members, not their square.

Links of lesser similarity differ in more bits than blocks of one fingerprint allow for. ``neighbourhoods`` files several
fingerprints of a row, over hashes of different seeds, and meets in the same index what is near in any one of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.llm.common import materialize, partitions, schema_with, small, spread, table, texts_of, with_columns
from stmtgauge.llm.components import components

SEED, SHINGLE, BITS = 42, 3, 3
FAN = 8
#: Fingerprints a task holds on average, and those of one block value above which it is dealt out in pairs of parts.
TASK_ROWS, SPLIT_ROWS = 400_000, 200_000
#: Rows whose fingerprints are packed together.
PACK_ROWS = 1 << 16
_STEP = 1 << 15


# -- fingerprints ----------------------------------------------------------------------------------------------------
def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """Bits that are set in over half the XXH64 of the word shingles; fewer words than a shingle make one, none give 0."""
    found = text.lower().split()  # of bytes: lowers A-Z, cuts at \x20 \x09-\x0D
    if not found:
        return 0
    hash64 = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(found) <= words:
        return hash64(b" ".join(found))
    shingles = map(b" ".join, zip(*[found[i:] for i in range(words)]))
    n, ones, block = len(found) - words + 1, np.zeros(64, np.int64), 1 << 16
    for at in range(0, n, block):
        h = np.fromiter((hash64(s) for s, _ in zip(shingles, range(block))), np.uint64, min(block, n - at))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Words whose bits all depend on all bits of ``x`` (the last steps of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add ``out``, the fingerprint as a signed BIGINT; null text counts as empty. No shuffle."""
    kept = docs.select(*[c for c in docs.columns if c != out])

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t) for t in texts_of(batch, text)), np.uint64, batch.num_rows)
            yield with_columns(batch, {out: pa.array(fps.view(np.int64))})

    return kept.mapInArrow(run, schema_with(kept, **{out: "bigint"}))


# -- the index inside a task -----------------------------------------------------------------------------------------
def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in Gray order: neighbours in this order differ in few bits."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Levels of nodes over fingerprints; nodes never hold fingerprints of two keys."""

    def __init__(self, keys: np.ndarray, fps: np.ndarray, fan: int = FAN):
        order = np.lexsort((gray_rank(fps), keys))
        self.order, self.fps, self.fan = order, fps[order], fan
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        #: Per level, from the leaves up: shared mask, shared pattern, first child, number of children, key.
        self.mask, self.pattern, self.first, self.size = [np.full(len(fps), every)], [self.fps], [None], [None]
        key = keys[order]
        while True:
            n = len(key)
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            within = np.arange(n) - np.repeat(head, np.diff(np.r_[head, n]))
            first = np.flatnonzero(within % fan == 0)
            mask, pattern = self.mask[-1], self.pattern[-1]
            ones = np.bitwise_and.reduceat(pattern & mask, first)
            zeros = np.bitwise_and.reduceat(~pattern & mask, first)
            self.mask.append(ones | zeros)
            self.pattern.append(ones)
            self.first.append(first)
            self.size.append(np.diff(np.r_[first, n]))
            key = key[first]
            if len(key) == len(np.unique(key)):
                break

    def connect(self, bits: int = BITS, pairs: int = _STEP) -> np.ndarray:
        """For each fingerprint as given the position of the first one, in index order, that is reachable inside a key.
        Nodes are compared ``pairs`` pairs at a time."""
        label = np.arange(len(self.fps))
        top = len(self.first) - 1
        roots = np.arange(len(self.first[top]))
        stack = [(top, roots, roots)]
        low, high = self._spans(label)
        while stack:
            level, i, j = stack.pop()
            if len(i) > pairs:
                stack += [(level, i[k : k + pairs], j[k : k + pairs]) for k in range(0, len(i), pairs)][::-1]
                continue
            # Both groups inside one known component: nothing to learn from them.
            open_ = ~((low[level][i] == high[level][i]) & (low[level][j] == high[level][j]) & (low[level][i] == low[level][j]))
            i, j = i[open_], j[open_]
            if not len(i):
                continue
            a, b = self._children(level, i, j)
            near = np.bitwise_count(
                (self.pattern[level - 1][a] ^ self.pattern[level - 1][b]) & self.mask[level - 1][a] & self.mask[level - 1][b]
            ) <= bits
            a, b = a[near], b[near]
            if level > 1:
                far = a != b
                stack += [(level - 1, a[far], b[far]), (level - 1, a[~far], b[~far])]
            elif len(a) and (label[a] != label[b]).any():
                label = _union(label, a, b)
                low, high = self._spans(label)
        out = np.empty(len(label), np.int64)
        out[self.order] = self.order[label]
        return out

    def _spans(self, label: np.ndarray) -> tuple[list, list]:
        """Lowest and highest component below each node."""
        low, high = [label], [label]
        for first in self.first[1:]:
            low.append(np.minimum.reduceat(low[-1], first))
            high.append(np.maximum.reduceat(high[-1], first))
        return low, high

    def _children(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of the node pairs; each unordered pair once, leaves not with themselves."""
        f = np.arange(self.fan)
        left, right = (x.ravel() for x in np.meshgrid(f, f, indexing="ij"))
        a = self.first[level][i][:, None] + left
        b = self.first[level][j][:, None] + right
        there = (left < self.size[level][i][:, None]) & (right < self.size[level][j][:, None])
        same = (i == j)[:, None]
        there &= ~same | ((left < right) if level == 1 else (left <= right))
        return a[there], b[there]


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the first member of its component) after joining the components of ``a`` and ``b``."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped


# -- the distributed join --------------------------------------------------------------------------------------------
def _nodes(number: Column, width: int) -> Column:
    """Top nodes of ``fp``, the fingerprint of this ``number`` of its row: one for each whole block of ``width`` bits."""
    blocks, mask = 64 // width, F.lit((1 << width) - 1)
    value = lambda i: F.shiftrightunsigned("fp", width * i).bitwiseAND(mask)
    return F.array(*[(F.shiftleft(number * blocks + i, width) + value(i)).cast("int") for i in range(blocks)])


def _dealt(filed: DataFrame, hot: DataFrame) -> DataFrame:
    """``fp``, ``id`` and ``key`` of ``filed``: rows of a key meet in one task. It stands for a node, or for a pair of the
    ``parts`` that ``hot`` has for it."""
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, part), F.greatest(o, part)))
    return (
        filed.join(hot, "node", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("pair", F.explode(others))
        .select("fp", "id", "node", F.xxhash64("node", "pair").alias("key"))
    )


def _met(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fp``, ``id`` and ``key`` of rows whose key another row has, too; lone members of a key have nobody to meet."""
    held = [(b["fp"].to_numpy(), b["id"].to_numpy(), b["key"].to_numpy()) for b in batches if len(b)]
    if not held:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    fp, ident, key = (np.concatenate(x) for x in zip(*held))
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    some = n[inverse] > 1
    return fp[some], ident[some], key[some]


def fingerprint_components(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """``fp`` and ``root`` for distinct fingerprints (``fp``, ``id`` BIGINT): the smallest id reachable over links of at
    most ``bits`` differing bits (3 at most). A fingerprint without a link is its own component.

    Each fingerprint is filed four times, so the shuffle is in proportion to the distinct fingerprints. A block value
    that holds more than ``SPLIT_ROWS`` of them is dealt out as pairs of parts to several tasks.
    """
    if bits > 3:
        raise ValueError("four blocks guarantee links of at most three differing bits")
    filed = fps.select("fp", "id", F.explode(_nodes(F.lit(0), 16)).alias("node"))
    counts = filed.groupBy("node").count()
    hot = counts.where(F.col("count") > SPLIT_ROWS).select(
        "node", F.ceil(F.col("count") / SPLIT_ROWS).cast("int").alias("parts")
    )
    hot = small(hot, 4 << 16, 16)  # 4 * 2^16 values at most, whatever the data
    rows = fps.count()
    tasks = max(partitions(fps), math.ceil(4 * rows / TASK_ROWS))
    dealt = _dealt(filed, hot)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fp, ident, key = _met(batches)
        if len(fp):
            first = GrayIndex(key, fp.view(np.uint64)).connect(bits)
            linked = ident != ident[first]
            yield pd.DataFrame({"a": ident[linked], "b": ident[first[linked]]})

    edges = dealt.repartition(tasks, "key").mapInPandas(link, "a bigint, b bigint")
    found = components(edges)
    return fps.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "fp", F.coalesce("component", "id").alias("root")
    )


def _planes(x: np.ndarray) -> bytes:
    """64-bit words as all their first bytes, all their second ones and so on; bytes that agree compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _words(planes: Iterable[bytes]) -> np.ndarray:
    """The words of several ``_planes``, one after the other."""
    return np.concatenate([np.frombuffer(p, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel() for p in planes])


def _filed(fps: DataFrame, width: int, ranges: int, hot: dict[int, int]) -> DataFrame:
    """Each fingerprint under each whole block of its bits, packed: ``slot`` (which fingerprint and which block), ``part``
    (a range of the block's values or, negative, a pair of the parts that ``hot`` has for a node), ``fp``, ``id`` and, where
    the rows have it, ``n``."""
    blocks, mask, own = 64 // width, np.uint64((1 << width) - 1), [c for c in ("id", "n") if c in fps.columns]
    split = {}
    for node, parts in hot.items():
        split.setdefault(node >> width, {})[node & int(mask)] = parts

    def of_slot(slot: int, fp: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[int, int, bytes, ...]]:
        value = (fp >> np.uint64(width * (slot % blocks)) & mask).astype(np.int64)
        order = np.argsort(value, kind="stable")
        fp, value, *rows = (x[order] for x in (fp, value, *rows))
        part = (value * ranges) >> width
        for v, parts in split.get(slot, {}).items():
            here = slice(*np.searchsorted(value, [v, v + 1]))
            one = (_mixed(fp[here]) % np.uint64(parts)).astype(np.int64)
            part[here] = -1
            for low in range(parts):
                for high in range(low, parts):
                    some = (one == low) | (one == high)
                    if some.any():
                        pair = -1 - (v << 44 | low << 22 | high)
                        yield slot, pair, *(_planes(x[here][some]) for x in (fp, *rows))
        fp, part, *rows = (x[part >= 0] for x in (fp, part, *rows))
        head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
        for s, e in zip(head, np.r_[head[1:], len(part)]):
            yield slot, int(part[s]), *(_planes(x[s:e]) for x in (fp, *rows))

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.concat_arrays([b.column("fps") for b in held]).fill_null([])
        given = [pa.concat_arrays([b.column(c) for b in held]).to_numpy(zero_copy_only=False).view(np.uint64) for c in own]
        ends, fps = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        for number in range(int(np.diff(ends).max(initial=0))):
            has = np.flatnonzero(np.diff(ends) > number)
            fp = fps[ends[has] + number]
            rows = [r for i in range(blocks) for r in of_slot(number * blocks + i, fp, [x[has] for x in given])]
            slot, part, *packed = zip(*rows)
            columns = [pa.array(slot, pa.int32()), pa.array(part, pa.int64()), *map(pa.array, packed)]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "part", "fp", *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= PACK_ROWS:
                yield from pack(held)
                held, n = [], 0
        if n:
            yield from pack(held)

    return fps.select("fps", *own).mapInArrow(run, ", ".join(["slot int, part bigint, fp binary", *(f"{c} binary" for c in own)]))


def neighbourhoods(fps: DataFrame, rows: int, number: int, width: int, bits: int) -> DataFrame:
    """``id``, ``key`` and ``m``: who lies near whom among ``rows`` rows of ``id`` (BIGINT, unique) and ``fps``, an array of
    about ``number`` fingerprints. First fingerprints are compared with first ones, second ones with second ones, and so on.

    A key stands for rows, two at least, whose fingerprints have a block of ``width`` bits in common and are reachable over
    links of at most ``bits`` differing bits; ``m`` is their number, added up over the blocks that bring the same rows
    together, which are one key. So rows share a key if some fingerprint of theirs agrees in a whole block and differs in
    at most ``bits`` bits in all; whether they are similar is for the caller to verify. A row without fingerprints has no
    key. Where ``fps`` has ``n`` (BIGINT) as well, ``low`` is the least ``n`` and ``least`` the least ``id`` of a key's rows. The shuffle holds every fingerprint once per block, packed by range of the block's value. A block value that more
    than ``SPLIT_ROWS`` rows have, judged by every 16th id, is dealt out as pairs of parts to several tasks; the driver is
    told these values, one for ``SPLIT_ROWS`` filed fingerprints at most.
    """
    blocks, hot, more = 64 // width, {}, ["low", "least"] if "n" in fps.columns else []
    columns = ["id", "key", "m", *more]
    if rows > SPLIT_ROWS:
        filed = fps.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0).select(F.posexplode("fps").alias("number", "fp"))
        counts = filed.select(F.explode(_nodes(F.col("number"), width)).alias("node")).groupBy("node").count()
        parts = F.ceil(16 * F.col("count") / SPLIT_ROWS).cast("int")
        hot = {r.node: r.parts for r in counts.select("node", parts.alias("parts")).where("parts > 1").collect()}
    tasks = max(partitions(fps), math.ceil(blocks * number * rows / (TASK_ROWS // 2)))
    ranges = min(1 << width, math.ceil(8 * tasks / (blocks * number)))  # so many that tasks get about equal shares

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, ident, n_of = _words(pdf["fp"]), _words(pdf["id"]), _words(pdf["n"]) if more else None
        value = (fp >> np.uint64(width * (int(pdf["slot"].iloc[0]) % blocks)) & np.uint64((1 << width) - 1)).astype(np.int64)
        _, inverse, n = np.unique(value, return_inverse=True, return_counts=True)
        some = n[inverse] > 1  # others have nobody to meet
        if not some.any():
            return pd.DataFrame({c: [] for c in columns}, dtype=np.int64)
        fp, ident = fp[some], ident[some]
        first = GrayIndex(value[some], fp).connect(bits, _STEP // 4)
        m, mixed = np.bincount(first, minlength=len(first))[first], np.zeros(len(first), np.uint64)
        np.add.at(mixed, first, _mixed(ident))  # the same members, the same sum
        near = m > 1
        out = {"id": ident[near].view(np.int64), "key": mixed[first[near]].view(np.int64), "m": m[near]}
        for c, x in zip(more, (n_of, ident)):
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, first, (x[some] if c == "low" else x).view(np.int64))
            out[c] = least[first[near]]
        return pd.DataFrame(out)

    met = _filed(fps, width, ranges, hot).repartition(tasks, "slot", "part").groupBy("slot", "part")
    found = met.applyInPandas(gather, ", ".join(f"{c} bigint" for c in columns))
    return found.groupBy("id", "key").agg(F.sum("m").alias("m"), *[F.min(c).alias(c) for c in more])


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (signed), ``fingerprint`` (16 hex digits) and ``component_id`` for every document.

    Documents are linked when their fingerprints differ in at most three bits; ``component_id`` is the smallest doc_id
    reachable, itself included. Documents of one fingerprint are represented by their smallest id before anything is
    compared, so thousands of exact copies cost one entry. Empty and null texts have fingerprint 0 and link like any
    other. A null doc_id takes its group's component and never names one (null if the whole group has none); repeated
    ids link through their fingerprints. Other columns are not looked at. An empty table gives no rows.
    """
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    fp = materialize(fingerprints(spread(narrow)).select("doc_id", "fp"), "fingerprints")
    return components_of(fp).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def components_of(fp: DataFrame) -> DataFrame:
    """Add ``component_id`` and ``root`` (which names the group even if no id of it is known) to rows with ``doc_id``
    and ``fp``."""
    distinct = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "fingerprints")
    found = fingerprint_components(distinct.select("fp", "id")).join(distinct.select("fp", "least"), "fp")
    found = materialize(found, "fingerprints")
    named = found.groupBy("root").agg(F.min("least").alias("component_id"))
    return fp.join(found.join(named, "root").select("fp", "root", "component_id"), "fp")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row of the smallest id (null last) stays, and one row
    if several bear it. Texts are written once with their fingerprints; the rows that go are joined away, by a broadcast
    if their measured number allows it."""
    names = {"fp": "__fp_given", "__row": "__row_given"}
    named = docs.withColumnsRenamed(names).withColumn("__row", F.monotonically_increasing_id())
    held = materialize(fingerprints(spread(named)), "documents")
    rows = components_of(held.select(F.col("doc_id").cast("bigint").alias("doc_id"), "fp", "__row"))
    kept = without_others(held, rows).drop("fp", "__row")
    return kept.withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def without_others(held: DataFrame, rows: DataFrame) -> DataFrame:
    """``held`` with one row of each ``root`` of ``rows`` (``root``, ``doc_id``, ``__row``): that of the smallest id."""
    rows = materialize(rows.select("root", F.struct(F.isnull("doc_id").alias("n"), "doc_id", "__row").alias("r")), "groups")
    stay = rows.groupBy("root").agg(F.min("r").alias("r")).select("r.__row")
    gone = materialize(rows.select("r.__row").join(stay, "__row", "left_anti"), "copies")
    return held.join(small(gone, gone.count(), 16), "__row", "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")
