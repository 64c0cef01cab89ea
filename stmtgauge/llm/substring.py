"""Substring dedup with difference-cover anchors.

A word window of length 13 that occurs in two documents at positions i and j need not be hashed at every position: with
the cover {1, 2, 4} modulo 7 there is, for all i and j, a shift of at most 6 that brings both to a cover position. So only
anchors are hashed and exchanged: 7 words beginning at a cover position. Any two equal windows share an aligned anchor.

1. Documents are dealt into ranges of ascending doc_id. Each range sends its distinct anchor hashes, sorted and packed
   per hash bucket; a bucket answers with one bit per hash: seen in another range or not.
2. From anchors that occur in two documents the ranges extend to all full windows around them, and send 96-bit hashes of
   these windows, again distinct and packed. The answer is one bit: does an earlier range, hence a smaller doc_id, hold it?
3. Each range marks the words of its repeated windows; inside a range smaller ids are compared directly.

A passage shared by a third of all documents costs one entry per range, as do thousands of copies of a text.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.llm.common import id_bounds, partitions, range_of, schema_with, spread, table, trimmed

WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: Text bytes of a range of documents, and hashes of a bucket; both bound the memory of a task.
RANGE_BYTES, BUCKET_HASHES = 4 << 20, 1_000_000
_LOW = np.uint64((1 << 40) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = regex.compile(rb"[^\x20\x09-\x0D]+")


def _rolled(h: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of the ``length`` items from each position on; past the end it is of no use."""
    base, powers = int(_ODD), {}
    size, level = 1, h
    while size <= length:
        powers[size] = level
        step = np.uint64(pow(base, size, 1 << 64))
        level = np.r_[level[:-size] + step * level[size:], level[-size:]] if len(level) > size else level
        size *= 2
    out, at = np.zeros(len(h), np.uint64), 0
    for size in sorted(powers, reverse=True):
        if length & size:
            factor = np.uint64(pow(base, at, 1 << 64))
            part = powers[size][at:]
            out[: len(part)] += factor * part
            at += size
    return out


class Range:
    """The documents of one range: word hashes, anchors, candidate windows, marks."""

    def __init__(self, docs: pd.DataFrame):
        docs = docs.sort_values("doc_id", kind="stable")
        self.docs = docs
        self.words = [(t or "").encode().split() for t in docs["text"]]
        number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.length = np.array([len(w) for w in self.words], np.int64)
        total = int(self.length.sum())
        index = np.fromiter((number[w] for ws in self.words for w in ws), np.int64, total)
        digests = [xxhash.xxh3_128_intdigest(w) for w in number]
        low = np.array([d & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64)
        high = np.array([d >> 64 for d in digests], np.uint64)
        self.a, self.b = low[index] if total else np.empty(0, np.uint64), high[index] if total else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(docs)), self.length)
        self.start = np.cumsum(self.length) - self.length
        place = np.arange(total) - self.start[self.doc]
        left = self.length[self.doc] - place
        self.ids = docs["doc_id"].to_numpy(np.int64)
        self.window_ok = left >= WINDOW
        cover = np.isin(place % PERIOD, COVER)
        self.at = np.flatnonzero(cover & (left >= ANCHOR) & (self.length[self.doc] >= WINDOW))
        self.anchors, self.of = np.unique(_rolled(self.a, ANCHOR)[self.at], return_inverse=True)

    def packed_anchors(self, buckets: int) -> list[tuple[int, int, bytes]]:
        """(bucket, number, 5-byte hashes): a filter, so that chance equality of 40 bits does no harm."""
        low = (self.anchors & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        return [(k, e - s, low[s:e].tobytes()) for k, s, e in _slices(self._anchor_buckets(buckets))]

    def _anchor_buckets(self, buckets: int) -> np.ndarray:
        return ((self.anchors >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)

    def extend(self, buckets: int, bits: dict[int, bytes]) -> None:
        """Full windows around the anchors that two documents hold; ``bits`` say so of other ranges."""
        elsewhere = _unpacked(self._anchor_buckets(buckets), bits)
        doc = self.doc[self.at]
        low, high = np.full(len(self.anchors), len(self.ids)), np.full(len(self.anchors), -1)
        np.minimum.at(low, self.of, doc)
        np.maximum.at(high, self.of, doc)
        here = low < high
        near = np.zeros((2, len(self.a) + 1 + PERIOD), np.int64)
        near[0, self.at + 1] = (here | elsewhere)[self.of]
        near[1, self.at + 1] = elsewhere[self.of]
        sums = near.cumsum(axis=1)
        n = len(self.a)
        found = (sums[:, PERIOD : PERIOD + n] - sums[:, :n]) > 0
        self.candidates = np.flatnonzero(found[0] & self.window_ok)
        far = found[1][self.candidates]
        a, b = _rolled(self.a, WINDOW)[self.candidates], _rolled(self.b, WINDOW)[self.candidates] & np.uint64(0xFFFFFFFF)
        order = np.lexsort((b, a))
        a, b, far = a[order], b[order], far[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        self.window = np.empty(len(a), np.int64)
        self.window[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        sent = np.maximum.reduceat(far, first) if len(first) else np.empty(0, bool)
        self.sent = np.flatnonzero(sent)
        self.hash_a, self.hash_b = a[first][self.sent], b[first][self.sent]
        self.count = len(first)

    def packed_windows(self, buckets: int) -> list[tuple[int, int, bytes]]:
        packed = np.concatenate(
            [
                self.hash_a.astype("<u8").view(np.uint8).reshape(-1, 8),
                self.hash_b.astype("<u4").view(np.uint8).reshape(-1, 4),
            ],
            axis=1,
        )
        return [(k, e - s, packed[s:e].tobytes()) for k, s, e in _slices(self._window_buckets(buckets))]

    def _window_buckets(self, buckets: int) -> np.ndarray:
        return ((self.hash_a >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)

    def marks(self, buckets: int, bits: dict[int, bytes]) -> np.ndarray:
        """For each word whether a window that began in a smaller doc_id covers it."""
        earlier = np.zeros(self.count, bool)
        earlier[self.sent] = _unpacked(self._window_buckets(buckets), bits)
        doc = self.ids[self.doc[self.candidates]]
        least = np.full(self.count, np.iinfo(np.int64).max)
        np.minimum.at(least, self.window, doc)
        repeated = self.candidates[earlier[self.window] | (doc > least[self.window])]
        change = np.zeros(len(self.a) + 1, np.int64)
        change[repeated] += 1  # starts are distinct
        np.add.at(change, repeated + WINDOW, -1)
        return change.cumsum()[:-1] > 0


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Contiguous stretches of ascending bucket numbers."""
    head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    for s, e in zip(head, np.r_[head[1:], len(bucket)]):
        yield int(bucket[s]), int(s), int(e)


def _unpacked(bucket: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(len(bucket), bool)
    for k, s, e in _slices(bucket):
        if k in bits:
            out[s:e] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=e - s).astype(bool)
    return out


def _answers(pdf: pd.DataFrame, width: int, phase: int) -> pd.DataFrame:
    """One bit per packed hash of each range: phase 1, whether two ranges hold it; phase 2, whether an earlier one does."""
    raw = np.frombuffer(b"".join(pdf["hashes"]), np.uint8).reshape(-1, width)
    full = np.zeros((len(raw), 16), np.uint8)
    full[:, :width] = raw
    a, b = full.view("<u8")[:, 0], full.view("<u8")[:, 1]
    size = pdf["n"].to_numpy(np.int64)
    owner = np.repeat(pdf["part"].to_numpy(np.int64), size)
    order = np.lexsort((owner, b, a))
    a, b, own = a[order], b[order], owner[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    group = np.diff(np.r_[first, len(a)])
    found = np.repeat(group > 1, group) if phase == 1 else own > np.repeat(own[first], group)
    bit = np.empty(len(a), bool)
    bit[order] = found
    ends = np.cumsum(size)
    return pd.DataFrame(
        {
            "part": pdf["part"],
            "phase": phase,
            "bucket": pdf["bucket"],
            "bits": [np.packbits(bit[e - n : e]).tobytes() for n, e in zip(size, ends)],
        }
    )


def _bits(pdf: pd.DataFrame, phase: int) -> dict[int, bytes]:
    rows = pdf[pdf["phase"] == phase]
    return dict(zip(rows["bucket"].tolist(), rows["bits"]))


_PACKED = "part int, bucket int, n int, hashes binary"
_BITS = "part int, phase int, bucket int, bits binary"
_ADDED = ("n_words", "n_removed", "kept_sha256")


def _kept_text(text: str, marks: np.ndarray) -> str:
    """The text without the marked words and the white space after them; what stays is not changed."""
    if not marks.any():
        return text
    raw = text.encode()
    at = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    runs = np.flatnonzero(np.diff(np.r_[1, marks.astype(np.int8), 1]))
    kept = [raw[: at[0]]] + [raw[at[s] : at[e]] for s, e in zip(runs[::2], runs[1::2])]
    return b"".join(kept).decode()


def without_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` (of the kept words joined by one space) of every row of
    ``docs``; with ``with_text`` all its columns as well, ``text`` cut (what stays of it is not changed), and columns of
    those names replaced.

    A word goes when a window of 13 words that covers it also starts in a document of smaller ``doc_id``; windows are
    those of the input. Null text has no words. Rows of null ``doc_id`` are kept as they are and count for nobody; rows
    of one id do not remove each other's words. Texts of less than 13 words stay. An empty table gives no rows.

    Texts are shuffled once, into ranges by doc_id that all three steps share; hashes go packed, answers as bits.
    """
    plain = docs.select(*[c for c in docs.columns if c not in _ADDED])
    others = [c for c in plain.columns if c != "text"]
    n_bytes, rows = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("doc_id")).first()
    parts = max(1, min(rows, max(partitions(docs), math.ceil(n_bytes / RANGE_BYTES))))
    buckets = max(1, partitions(docs), math.ceil(n_bytes / 12 / BUCKET_HASHES))
    bounds = id_bounds(docs, parts)
    named = plain.where("doc_id IS NOT NULL").select(
        range_of(bounds).alias("part"), F.col("doc_id").cast("bigint").alias("doc_id"), "text",
        F.struct(*others).alias("row") if with_text else F.lit(0).alias("row"),
    )
    ranges = named.repartition("part")

    def anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        found = Range(pdf).packed_anchors(buckets)
        return pd.DataFrame([(pdf["part"].iloc[0], *x) for x in found], columns=["part", "bucket", "n", "hashes"])

    def windows(pdf: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=["part", "bucket", "n", "hashes"])
        r = Range(pdf)
        r.extend(buckets, _bits(bits, 1))
        found = r.packed_windows(buckets)
        return pd.DataFrame([(pdf["part"].iloc[0], *x) for x in found], columns=["part", "bucket", "n", "hashes"])

    def cut(pdf: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        r = Range(pdf)
        r.extend(buckets, _bits(bits, 1))
        marks = r.marks(buckets, _bits(bits, 2))
        n_removed, digests, texts = [], [], []
        for words, s, n, text in zip(r.words, r.start, r.length, r.docs["text"]):
            m = marks[s : s + n]
            n_removed.append(int(m.sum()))
            kept = itertools.compress(words, ~m) if n_removed[-1] else words
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            if with_text:
                texts.append(_kept_text(text, m) if text is not None else None)
        out = pd.DataFrame({"doc_id": r.ids, "n_words": r.length, "n_removed": n_removed, "kept_sha256": digests})
        if with_text:
            out["row"], out["text"] = r.docs["row"].to_numpy(), texts
        return out

    first = ranges.groupBy("part").applyInPandas(lambda pdf: trimmed(anchors, pdf), _PACKED)
    bits1 = first.groupBy("bucket").applyInPandas(lambda pdf: _answers(pdf, 5, 1), _BITS)
    second = ranges.groupBy("part").cogroup(bits1.groupBy("part")).applyInPandas(lambda pdf, bits: trimmed(windows, pdf, bits), _PACKED)
    bits2 = second.groupBy("bucket").applyInPandas(lambda pdf: _answers(pdf, 12, 2), _BITS)
    both = bits1.unionByName(bits2)
    out = schema_with(plain.select(F.col("doc_id").cast("bigint").alias("doc_id")), n_words="bigint", n_removed="bigint")
    out = out.add("kept_sha256", "string")
    if with_text:
        out = out.add("row", named.schema["row"].dataType).add("text", "string")
    done = ranges.groupBy("part").cogroup(both.groupBy("part")).applyInPandas(lambda pdf, bits: trimmed(cut, pdf, bits), out)
    kept = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in plain.columns]
    done = done.select(*(kept if with_text else ["doc_id"]), *_ADDED)
    return done.unionByName(_nameless(plain.where("doc_id IS NULL"), with_text))


def _nameless(rows: DataFrame, with_text: bool) -> DataFrame:
    """Rows without an id: nothing is removed from them."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    values = {
        "n_words": F.size(words).cast("bigint"),
        "n_removed": F.lit(0).cast("bigint"),
        "kept_sha256": F.sha2(F.array_join(words, " ").cast("binary"), 256),
    }
    kept = rows.columns if with_text else [F.col("doc_id").cast("bigint").alias("doc_id")]
    return rows.select(*kept, *[values[k].alias(k) for k in _ADDED])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return without_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
