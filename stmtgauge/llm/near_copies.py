"""Near-dedup by the Jaccard similarity of word shingles.

Texts of equal shingle sets are one entry. Each set has a row of 64-bit SimHash fingerprints, over hashes of different seeds,
and entries meet in the Gray-order index (``simhash.neighbourhoods``): in some fingerprint a whole block of bits must agree
and at most ``NEAR`` bits of all may differ. Who meets is verified by the sets themselves, so no link is wrong. Two sets of
similarity 0.8 differ in a bit with probability 0.15 and so share one fingerprint's block and radius with 0.43 (blocks of 12
bits), some of 20 with 0.999985; at 0.85 they miss each other once in 60 million. Sets of up to ``FEW`` shingles, where a
majority is easily turned, have twice as many fingerprints. Blocks are wider for more documents, so that up to some
tens of millions of them a block's value is shared by some hundreds of random entries; wider blocks take more fingerprints to
be as sure.

Near copies of a text have up to a hundred neighbourhoods each, of much the same members. Those of one smallest id become one
band, and that with the bands in which this entry has a smaller one in turn: who has met in a neighbourhood still meets in
a band, and an entry has a few bands only. A band that many share is not compared pair by pair. Entries go first that cannot be
similar to anybody, because too many of their shingles are their own; the index says how small the smallest set of a band
is. The others meet the one in the midst of a band, which connects most copies of a text. The rest meets one member outside the first component, and what is apart even then meets in parts of
bounded size, where one product of matrices gives the overlaps of all pairs and only links that connect something new come out.

One fingerprint of 64 bits cannot find these links: at similarity 0.8 it differs in 10 bits on average and in 17 at times,
and blocks of which one must agree would be four bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtgauge.llm.common import materialize, schema_with, short_batches, small, spread, texts_of, with_columns, written
from stmtgauge.llm.components import components
from stmtgauge.llm.simhash import _mixed, _union, neighbourhoods, without_others
from stmtgauge.sources.storage import remove

WORDS, LEAST, SEED = 5, 0.8, 42
#: Differing bits up to which fingerprints are near, and the size of sets that have twice as many of them.
NEAR, FEW = 10, 5
#: Number of documents up to which blocks have so many bits and a set so many fingerprints.
BLOCKS = [(1 << 20, 12, 20), (1 << 23, 14, 32), (1 << 63, 16, 43)]
#: Entries of a band that are compared with each other or with another part in one task.
PART_ROWS = 512
_BLOCK, _PACK, _WIDE = 1 << 16, 1 << 20, 1 << 13
_SEEDS = np.random.default_rng(SEED).integers(0, 2**64, 2 * BLOCKS[-1][2], np.uint64)
_EIGHTH = np.uint64(0x0101010101010101)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct XXH64 of the word shingles, ascending; fewer words than a shingle make one, no words none."""
    found = text.lower().split()  # of bytes: lowers A-Z, cuts at \x20 \x09-\x0D
    hash64 = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(found) <= words:
        return np.array([hash64(b" ".join(found))] if found else [], np.uint64)
    pieces = map(b" ".join, zip(*[found[i:] for i in range(words)]))
    return np.unique(np.fromiter(map(hash64, pieces), np.uint64, len(found) - words + 1))


def fingerprints(found: np.ndarray, number: int) -> list[int]:
    """SimHash of a set by ``number`` seeds, as signed words: bits that over half of the seeded hashes have. None for the
    empty set."""
    if not len(found):
        return []
    number *= 2 if len(found) <= FEW else 1
    ones, step = np.zeros((number, 8, 8), np.int64), max(255, _BLOCK // number)
    for at in range(0, len(found), step):
        h = _mixed(found[None, at : at + step] ^ _SEEDS[:number, None])
        parts = np.arange(0, h.shape[1], 255)  # eight counters of a byte in a word
        for bit in range(8):
            sums = np.add.reduceat((h >> np.uint64(bit)) & _EIGHTH, parts, axis=1)
            ones[:, bit] += sums.view(np.uint8).reshape(number, len(parts), 8).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones.reshape(number, 64) > len(found), axis=1).view(np.int64).ravel().tolist()


def _filed(docs: DataFrame, words: int, number: int) -> DataFrame:
    """Add ``__digest`` and size ``__n`` of the shingle set and ``__fps``, its fingerprints. No shuffle."""

    def run(batches):
        for batch in batches:
            digest, n, fps = [], [], []
            for t in texts_of(batch, "text"):
                found = shingles(t, words)
                digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                n.append(len(found))
                fps.append(fingerprints(found, number))
            added = {"__digest": pa.array(digest, pa.binary()), "__n": pa.array(n, pa.int64())}
            yield with_columns(batch, added | {"__fps": pa.array(fps, pa.list_(pa.int64()))})

    return docs.mapInArrow(run, schema_with(docs, __digest="binary", __n="bigint", __fps="array<bigint>"))


def sketch(found: np.ndarray) -> bytes:
    """For each value of the lowest bits whether an odd number of members has it; there are more values than members, 64 at
    least. Sets differ in at least as many members as their sketches in bits."""
    bits = 1 << max(6, len(found).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(one: bytes, two: bytes) -> int:
    """Number of members that at least are in only one of two sets, by their sketches; the longer one is folded."""
    x, y = sorted((np.frombuffer(s, np.uint64) for s in (one, two)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum())


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``id``, ``n``, ``sketch`` and ``shingles`` (ascending) of the texts. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, done, held, size = batch.column("id"), batch.column("n"), 0, [], 0
            for t in [*texts_of(batch, "text"), None]:
                if t is not None:
                    held.append(shingles(t, words))
                    size += len(held[-1])
                if held and (t is None or size >= _PACK):
                    ends = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held).view(np.int64)))
                    own = [x.slice(done, len(held)) for x in (ids, n)]
                    own.append(pa.array(map(sketch, held), pa.binary()))
                    yield pa.RecordBatch.from_arrays([*own, lists], ["id", "n", "sketch", "shingles"])
                    done, held, size = done + len(held), [], 0

    return texts.select("id", "n", "text").mapInArrow(run, "id bigint, n bigint, sketch binary, shingles array<bigint>")


def _of_pairs(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``a`` and ``b`` of the pairs with ``column`` of the sets of both, as ``t`` and ``u``. Of the sets only those of the
    pairs are shuffled, as long as the pairs may be broadcast."""
    n = pairs.count()
    met = small(pairs, n, 24).join(sets.select(F.col("id").alias("b"), F.col(column).alias("u")), "b")
    first = sets.join(small(pairs.select(F.col("a").alias("id")).distinct(), n, 16), "id", "left_semi")
    return met.join(first.select(F.col("id").alias("a"), F.col(column).alias("t")), "a").select("a", "b", "t", "u")


def _possible(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose sketches do not rule out a similarity of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for t, u, n in zip(batch.column("t"), batch.column("u"), batch.column("n").to_pylist()):
                most = (n - apart(t.as_py(), u.as_py())) / 2  # members in common
                near.append(most >= least * (n - most))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    whole = sets.select("id", F.struct("sketch", "n").alias("s"))
    met = _of_pairs(pairs, whole, "s").select("a", "b", "t.sketch", F.col("u.sketch").alias("u"), (F.col("t.n") + F.col("u.n")).alias("n"))
    return met.withColumnRenamed("sketch", "t").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets have a similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for t, u in zip(batch.column("t"), batch.column("u")):
                one, two = (x.values.to_numpy(zero_copy_only=False) for x in (t, u))
                both = len(np.intersect1d(one, two, assume_unique=True))
                near.append(both >= least * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return _of_pairs(pairs, sets, "shingles").mapInArrow(run, "a bigint, b bigint")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common members of all pairs of sets: the product of their incidence matrix with itself, without what one
    set has alone."""
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), n > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[at]], place[at[shared[at]]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(shared.sum()), _WIDE):
        here = slice(*np.searchsorted(column, [low, low + _WIDE]))
        m = np.zeros((len(sets), _WIDE), np.float32)
        m[row[here], column[here] - low] = 1
        out += m @ m.T
    return out


def _with_partner(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """The rows whose sketches do not rule out a similarity of ``least`` (over a half) to one of another component."""
    n, label, found = pdf["n"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64), np.zeros(len(pdf), bool)
    words = np.array([len(s) // 8 for s in pdf["sketch"]])
    rows = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
    bits = {w: np.frombuffer(b"".join(pdf["sketch"].iloc[at]), np.uint64).reshape(-1, w) for w, at in rows.items()}
    for w, one in rows.items():
        for v in (w, 2 * w):  # sketches of other lengths are of sets more than twice as large
            if v not in rows:
                continue
            two = rows[v]
            folded = bits[v][:, :w] ^ bits[v][:, w:] if v > w else bits[v]
            alone = np.zeros((len(one), len(two)), np.int32)
            for x, y in zip(bits[w].T, folded.T):
                alone += np.bitwise_count(x[:, None] ^ y[None, :])
            whole = n[one][:, None] + n[two][None, :]
            most = (whole - alone) / 2  # members in common
            near = (most >= least * (whole - most)) & (label[one][:, None] != label[two][None, :])
            found[one[near.any(axis=1)]] = True
            found[two[near.any(axis=0)]] = True
    return pdf.loc[found, ["key", "id", "c", "low", "high"]]


def _compared(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between members of different components that connect all whose sets are similar."""
    ids, label = pdf["id"].to_numpy(np.int64), np.unique(pdf["c"].to_numpy(np.int64), return_index=True, return_inverse=True)
    if len(label[0]) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    sets = [np.asarray(s) for s in pdf["shingles"]]
    n, both = np.array([len(s) for s in sets], np.float32), overlaps(sets)
    near = (both >= least * (n[:, None] + n[None, :] - both)) & (label[2][:, None] < label[2][None, :])
    a, b = np.nonzero(near)
    joined = _union(np.arange(len(label[0])), label[2][a], label[2][b])
    apart = joined != np.arange(len(joined))  # each component with the first it is connected to
    return pd.DataFrame({"a": ids[label[1][apart]], "b": ids[label[1][joined[apart]]]})


def _joined(near: DataFrame) -> DataFrame:
    """``id``, ``key``, ``m`` and ``low`` of bands of joined neighbourhoods: of those of the same smallest id, and then of those
    whose smallest ids have the same smallest one to share a neighbourhood with. No two that share one are separated."""
    if "least" not in near.columns:
        near = near.join(near.groupBy("key").agg(F.min("id").alias("least")), "key").withColumn("low", F.lit(0).cast("bigint"))
    sums = F.sum("m").alias("m"), F.min("low").alias("low")
    once = materialize(near.groupBy("id", "least").agg(*sums), "bands")
    of = once.groupBy(F.col("id").alias("least")).agg(F.min("least").alias("key"))
    return once.join(small(of, of.count(), 16), "least").groupBy("id", "key").agg(*sums)


class _Bands:
    """Who shares a band with whom, and which components are known so far. Bands are the neighbourhoods in the index, joined.

    ``at`` has a row per entry and band it shares with another component: ``id``, ``n`` (size of its set), ``key``, ``m``
    (its members), ``low`` (not above the size of the smallest), ``score`` (members of all its bands, which is largest in the
    midst of a group of copies), ``c`` (its component).
    """

    def __init__(self, near: DataFrame, texts: DataFrame, words: int, least: float):
        self.least, self.spark, self.edges, self.paths = least, near.sparkSession, None, []
        at = self.keep(_joined(near), "bands")
        score = self.keep(at.groupBy("id").agg(F.sum("m").alias("score")), "scores")
        self.n = n = score.count()
        # Texts stay where they are as long as the ids of those needed may be broadcast.
        self.sets = self.keep(_sets(texts.join(small(score.select("id"), n, 16), "id", "left_semi"), words), "sets")
        self.groups = None
        known = small(self.sets.select("id", "n").join(score, "id"), n, 32)
        self.at = at.join(known, "id").select("id", "n", "key", "m", "low", "score", F.col("id").alias("c"))

    def keep(self, df: DataFrame, purpose: str) -> DataFrame:
        with short_batches(self.spark):
            df, path = written(df, purpose)
        self.paths.append(path)
        return df

    def end(self) -> None:
        """The tables go; what ``groups`` reads stays."""
        for path in self.paths:
            remove(self.spark, path)

    def of(self, column: str, members: DataFrame) -> DataFrame:
        """``id`` and ``column`` of the sets of ``members``; others are not shuffled if the ids may be broadcast."""
        ids = small(members.select("id").distinct(), self.n, 16)
        return self.sets.select("id", column).join(ids, "id", "left_semi")

    def link(self, found: DataFrame) -> None:
        """Take up new links."""
        found = self.keep(found, "links")
        self.edges = found if self.edges is None else self.edges.unionByName(found)
        self.groups = components(self.edges)

    def narrow(self) -> bool:
        """Name the components, leave the bands of one, which have nothing more to say; whether others are left."""
        known = small(self.groups.withColumnRenamed("node", "id"), self.groups.count(), 24)
        named = self.at.drop("c").join(known, "id", "left")
        at = self.keep(named.withColumn("c", F.coalesce("component", "id")).drop("component"), "bands")
        several = at.groupBy("key").agg(F.min("c").alias("first"), F.max("c").alias("last")).where("first <> last")
        self.at = self.keep(at.join(several.select("key"), "key"), "bands")
        return not self.at.isEmpty()

    def meet_centre(self, other: bool = False, once: bool = False) -> None:
        """All members of a band meet the one of the largest score, or of those outside its component the one that is. With
        ``once`` everyone does so in one band only, that of the most members: a row per entry, however many bands it has."""
        rank = F.struct(-F.col("score"), F.xxhash64("id"), "id")
        first = F.min_by(F.struct("id", "n", "c"), rank)
        centre = self.at.groupBy("key").agg(first.alias("o"))
        if other:
            rest = self.at.join(centre.select("key", F.col("o.c").alias("c0")), "key").where("c <> c0")
            centre = rest.groupBy("key").agg(first.alias("o"))
        centre = centre.select("key", F.col("o.id").alias("id2"), F.col("o.n").alias("n2"), F.col("o.c").alias("c2"))
        similar = F.least("n", "n2") >= F.lit(self.least) * F.greatest("n", "n2")
        pair = [F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")]
        at = self.at
        if once:
            at = at.groupBy("id", "n", "c").agg(F.max_by("key", F.struct("m", "key")).alias("key"))
        pairs = at.join(centre, "key").where((F.col("c") != F.col("c2")) & similar).select(*pair).distinct()
        near = self.keep(_possible(self.keep(pairs, "pairs"), self.sets, self.least), "pairs")
        self.link(_verified(near, self.sets, self.least))

    def without_loners(self) -> None:
        """Leave entries that hold too many shingles of their own to be similar to any other one of their bands.

        With ``u`` shingles that nobody else has, a set of ``n`` has at most ``n - u`` in common with another, whose size
        is at least ``low``: their similarity is at most (n - u) / (low + u).
        """
        low = self.at.groupBy("id", "n").agg(F.min("low").alias("low"))
        low = self.keep(low.withColumn("low", F.greatest("low", F.lit(self.least) * F.col("n"))), "lows")
        own = self.sets.join(small(low.select("id"), self.n, 16), "id", "left_semi").select("id", F.explode("shingles").alias("s"))
        own = own.groupBy("s").agg(F.count("*").alias("m"), F.min("id").alias("id")).where("m = 1")
        own = own.groupBy("id").agg(F.count("*").alias("u"))
        loners = F.col("n") - F.col("u") < F.lit(self.least) * (F.col("low") + F.col("u"))
        loners = self.keep(low.join(own, "id").where(loners).select("id"), "loners")
        self.at = self.keep(self.at.join(small(loners, self.n, 16), "id", "left_anti"), "bands")

    def meet_all(self) -> None:
        """Members of a band that are still apart meet each other, in pairs of parts of bounded size: by their sketches first,
        then those by their sets that may be similar to one of another component."""
        parts = self.at.groupBy("key").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
        own = F.pmod(F.xxhash64("id"), "parts").cast("int")
        others = F.sequence(F.lit(0), F.col("parts") - 1)
        tasks = F.transform(others, lambda o: F.struct(F.least(o, own).alias("low"), F.greatest(o, own).alias("high")))
        dealt = self.at.join(parts, "key").select("key", "id", "n", "c", F.inline(tasks))
        least, schema = self.least, "key bigint, id bigint, c bigint, low int, high int"
        sketched = dealt.join(self.of("sketch", self.at), "id").groupBy("key", "low", "high")
        near = self.keep(sketched.applyInPandas(lambda pdf: _with_partner(pdf, least), schema), "near")
        near = near.join(self.of("shingles", near), "id").groupBy("key", "low", "high")
        found = near.applyInPandas(lambda pdf: _compared(pdf, least), "a bigint, b bigint")
        self.link(found)


def _linked(near: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """``node`` and ``component`` of the entries that are linked with another one, out of those that share a ``key``."""
    bands_ = _Bands(near, texts, words, least)
    bands_.without_loners()
    bands_.meet_centre(once=True)
    if bands_.narrow():
        bands_.meet_centre()
        if bands_.narrow():
            bands_.without_loners()
            bands_.meet_centre(other=True)
            if bands_.narrow():
                bands_.without_loners()
                bands_.meet_all()
    groups = materialize(bands_.groups, "groups")
    bands_.end()
    return groups


def one_of_each_group(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row of the smallest id (null last) stays, and one row
    if several bear it.

    Rows are linked when their sets of ``words``-word shingles (A-Z in lower case) have a Jaccard similarity of ``least``
    or more; links are followed on. Texts of no words, null ones too, are copies of each other. Links come from the
    Gray-order index of SimHash fingerprints and are verified; its recall holds for ``least`` of 0.8 and up. An empty
    table gives no rows.
    """
    if least < LEAST:
        raise ValueError(f"the fingerprints are made for similarities of {LEAST} or more")
    own = ["__row", "__digest", "__n", "__fps"]
    names = {c: f"{c}_given" for c in own}
    named = docs.withColumnsRenamed(names).withColumn("__row", F.monotonically_increasing_id())
    rows = docs.count()
    _, width, number = next(x for x in BLOCKS if rows <= x[0])
    with short_batches(docs.sparkSession):
        held = materialize(_filed(spread(named), words, number), "documents")
    first = materialize(held.groupBy("__digest").agg(F.min("__row").alias("id")), "entries")
    entries, texts = first.count(), held.select(F.col("__row").alias("id"), F.col("__n").alias("n"), "text")
    fps = held.select(F.col("__row").alias("id"), F.col("__n").alias("n"), F.col("__fps").alias("fps"))
    fps = fps.join(small(first.select("id"), entries, 16), "id", "left_semi")
    groups = _linked(neighbourhoods(fps, entries, number, width, NEAR), texts, words, least)
    roots = first.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "__digest", F.coalesce("component", "id").alias("root")
    )
    rows = held.select(F.col("doc_id").cast("bigint").alias("doc_id"), "__row", "__digest").join(roots, "__digest")
    kept = without_others(held, rows).drop(*own)
    return kept.withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)
