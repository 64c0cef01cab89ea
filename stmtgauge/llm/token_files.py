"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id, and a bitmap says which ids go on; level 1
holds the next chunk of those, with a bitmap of its own, and so on. A rank directory (ones before each 512 bits) leads from
a place in one level to its place in the next, so that any token is read by a few looks, without decoding its block.

File: segments one after the other, each ended by a line feed. Segment: header, doc ids, null flags, ends (tokens up to
the end of each document), then per level its length, chunks, bitmap and rank directory. All numbers are little-endian.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from stmtgauge.llm.common import id_bounds, materialize, partitions, range_of, small, spread, table, texts_of
from stmtgauge.sources.storage import fresh_folder

END_ID = 2
#: Tokens after which a segment ends, and segments in a file; both bound what a reader holds.
SEGMENT_TOKENS, FILE_SEGMENTS = 1 << 19, 16
_MAGIC = b"DAC1"
_HEAD = struct.Struct("<4siiqqqi")  # magic, part, number in part, tokens of the part before, documents, tokens, levels
_BLOCK = 512

#: Words and pre-tokens a worker remembers (the first it meets, so the frequent ones), and the longest of them; results do
#: not depend on these.
REMEMBERED, REMEMBERED_BYTES = 300_000, 40
#: Words, and new pre-tokens, that are looked up together.
_CHUNK = 4096


# -- directly addressable codes --------------------------------------------------------------------------------------
class Dac:
    """Codes of a sequence of ids; ``dac[i]`` reads one, ``decode()`` all."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels  # chunks, bitmap (least bit first), ones before each block

    @classmethod
    def encode(cls, ids: np.ndarray) -> Dac:
        rest, levels = ids.astype(np.uint32), []
        while True:
            more = rest > 0xFF
            bitmap = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(more, np.arange(0, len(more), _BLOCK), dtype=np.uint32) if len(more) else more
            ranks = (np.cumsum(ones) - ones).astype("<u4")
            levels.append(((rest & 0xFF).astype(np.uint8), bitmap, ranks))
            if not more.any():
                return cls(levels)
            rest = rest[more] >> np.uint32(8)

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // _BLOCK
            before = bitmap[block * _BLOCK // 8 : i >> 3]
            part = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + part.bit_count()
        return value

    def decode(self) -> np.ndarray:
        value = np.empty(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            here[more] |= value << np.uint32(8)
            value = here
        return value

    def to_bytes(self) -> bytes:
        out = []
        for chunks, bitmap, ranks in self.levels:
            out += [struct.pack("<q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
        return b"".join(out)

    @classmethod
    def read(cls, data: memoryview, at: int, n_levels: int) -> tuple[Dac, int]:
        levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<q", data, at)
            sizes, at, parts = (n, -(-n // 8), 4 * -(-n // _BLOCK)), at + 8, []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4")):
                parts.append(np.frombuffer(data[at : at + size], kind))
                at += size
            levels.append(tuple(parts))
        return cls(levels), at


def pack_segment(part: int, number: int, before: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A segment of documents and their ids."""
    dac = Dac.encode(np.concatenate(ids))
    ends = np.cumsum([len(x) for x in ids]).astype("<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(_MAGIC, part, number, before, len(ids), int(ends[-1]), len(dac.levels))
    return b"".join([head, named.tobytes(), null.tobytes(), ends.tobytes(), dac.to_bytes()])


class Segment:
    def __init__(self, data: memoryview, at: int):
        magic, self.part, self.number, self.before, n, self.tokens, n_levels = _HEAD.unpack_from(data, at)
        if magic != _MAGIC:
            raise ValueError("not a segment of token ids")
        at += _HEAD.size
        self.doc_ids = np.frombuffer(data[at : at + 8 * n], "<i8")
        self.null = np.frombuffer(data[at + 8 * n : at + 9 * n], np.uint8)
        self.ends = np.frombuffer(data[at + 9 * n : at + 17 * n], "<i8")
        self.dac, self.stop = Dac.read(data, at + 17 * n, n_levels)


def segments(content: bytes) -> Iterator[Segment]:
    data, at = memoryview(content), 0
    while at < len(data):
        segment = Segment(data, at)
        yield segment
        at = segment.stop + 1  # the line feed


# -- encoding --------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def _of_pretokens(path: str) -> Tokenizer:
    """The tokenizer for texts that are pre-tokens already, normalized and with spaces in between."""
    bare = Tokenizer.from_file(path)
    bare.normalizer = normalizers.Sequence([])
    to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), to_bytes])
    return bare


class Encoder:
    """Ids of texts by the tokenizers library, asked once per distinct pre-token as far as memory allows.

    For a vocabulary that lowers case, drops white space and marks ends of words, a text is the sequence of its words, and
    a word of plain characters the sequence of its pre-tokens. New words are split many at a time, and so do new pre-tokens
    go to the library; their ids are told apart by the word ends. Whatever is not plain (special strings, other scripts, marks) goes to it unsplit.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and bool(suffix) and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        if self.by_word:
            self.parted = regex.compile(steps[0]["pattern"]["Regex"] + r"|\n")
            vocab = spec["model"]["vocab"]
            self.pretokens = _of_pretokens(path)
            self.ends = np.zeros(self.pretokens.get_vocab_size(), bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(_tokenizer(self.path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [self.direct(t.decode()) for t in texts]
        split = [None if any(s in t for s in self.specials) else t.split() for t in texts]
        words = self.words
        new = set(chain.from_iterable(ws for ws in split if ws)).difference(words)
        learnt = self._learn(new)
        words.update(learnt)
        get = words.__getitem__
        out = [self.direct(t.decode()) if ws is None else b"".join(map(get, ws)) for t, ws in zip(texts, split)]
        room = REMEMBERED - (len(words) - len(learnt))
        for n, w in enumerate(learnt):
            if n >= room or len(w) > REMEMBERED_BYTES:
                del words[w]
        return out

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        todo = list(words)
        for at in range(0, len(todo), _CHUNK):
            chunk = todo[at : at + _CHUNK]
            if not self._plain(b"\n".join(chunk).decode()):
                odd = [w for w in chunk if not self._plain(w.decode())]
                found.update((w, self.direct(w.decode())) for w in odd)
                chunk = list(set(chunk).difference(odd))
            if chunk:
                found.update(self._of_parts(chunk))
        return found

    @staticmethod
    def _plain(text: str) -> bool:
        """Below U+0130 nothing composes, and lowering a character depends on nothing around it."""
        return (text.isascii() or max(text) < "\u0130") and text.replace("\n", "").isprintable()

    def _of_parts(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of plain words: all are split at once, new pre-tokens go to the library together, and what comes back is
        cut at the word ends."""
        flat = self.parted.findall(b"\n".join(words).decode().lower())
        new = list(set(flat).difference(self.parts, "\n"))
        known = self.parts.get
        learnt: dict[str, bytes] = {"\n": b""}
        for at in range(0, len(new), _CHUNK):
            some = new[at : at + _CHUNK]
            ids = np.array(self.pretokens.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                learnt.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends))))
            else:
                learnt.update((p, self.direct(p)) for p in some)
        ids = [known(p) or learnt[p] for p in flat]
        stop = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        breaks = np.flatnonzero(np.fromiter(("\n" == p for p in flat), bool, len(flat)))
        ends = [*stop[breaks].tolist(), int(stop[-1]) if len(stop) else 0]
        raw = b"".join(ids)
        del learnt["\n"]
        room = REMEMBERED - len(self.parts)
        if room > 0:
            self.parts.update((p, v) for p, v in islice(learnt.items(), room) if len(p) <= REMEMBERED_BYTES)
        return dict(zip(words, map(raw.__getitem__, map(slice, [0, *ends], ends))))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One per worker process, for all its tasks."""
    return Encoder(path)


# -- writing and reading ---------------------------------------------------------------------------------------------
_GROUP_BYTES = 2 << 20


def encoded_ids(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """``doc_id``, ``width`` and ``ids`` (little-endian, ``width`` = 2 or 4 bytes each, with the end id) of every row;
    null text is empty."""
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            held, size, done = [], 0, 0
            for text in [*texts_of(batch, "text"), None]:
                if text is not None:
                    held.append(text)
                    size += len(text)
                if held and (text is None or size >= _GROUP_BYTES):
                    ids = [np.frombuffer(x + end, "<u4") for x in encoder.encode(held)]
                    width = [2 if not len(x) or x.max() < 1 << 16 else 4 for x in ids]
                    raw = [x.astype("<u2").tobytes() if w == 2 else x.tobytes() for x, w in zip(ids, width)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(done, len(held)), pa.array(width, pa.int32()), pa.array(raw, pa.binary())],
                        ["doc_id", "width", "ids"],
                    )
                    done, held, size = done + len(held), [], 0

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, width int, ids binary")


def write_token_files(ids: DataFrame, bounds: np.ndarray, folder: str) -> None:
    """Write ``doc_id``, ``width``, ``ids`` in ascending doc_id order (null first, ties by their ids) as files of segments.

    Each range of ids is one task and one file, or more files when it is long; Spark's commit keeps a file only once,
    whatever tasks are lost or repeated.
    """
    parts = len(bounds) + 2
    dealt = ids.withColumn("part", range_of(bounds))
    ordered = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "ids")

    def pack(batches):
        part, number, before, names, held, size = None, 0, 0, [], [], 0

        def close():
            nonlocal number, before, names, held, size
            data = pack_segment(part, number, before, names, held)
            number, before, names, held, size = number + 1, before + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["payload"])

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("part", "doc_id", "width"))
            for p, doc, width, raw in zip(*columns, batch.column("ids")):
                raw = np.frombuffer(raw.as_py(), f"<u{width}")
                if held and (p != part or size >= SEGMENT_TOKENS):
                    yield close()
                if p != part:
                    part, number, before = p, 0, 0
                names.append(doc)
                held.append(raw)
                size += len(raw)
        if held:
            yield close()

    packed = ordered.mapInArrow(pack, "payload binary")
    # The text writer puts the bytes out as they are, each row ended by a line feed.
    raw = packed.select(F.col("payload").cast("string").alias("value"))
    raw.write.option("maxRecordsPerFile", FILE_SEGMENTS).text(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files, from what they hold: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32`` (of the little-endian 32-bit ids)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                for s in segments(content):
                    ids = s.dac.decode().astype("<u4").tobytes()
                    ends = s.ends.tolist()
                    starts = [0, *ends[:-1]]
                    yield pd.DataFrame(
                        {
                            "part": s.part,
                            "doc_id": pd.array(s.doc_ids, "Int64").copy() if not s.null.any() else _named(s),
                            "before": s.before + np.array(starts),
                            "n_tokens": np.diff(np.r_[0, s.ends]),
                            "ids_crc32": [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, ends)],
                        }
                    )

    schema = "part int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"
    read = materialize(files.mapInPandas(run, schema), "token-rows")
    sizes = read.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return read.join(small(offsets, sizes.count(), 24), "part").select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def _named(s: Segment) -> pd.Series:
    ids = pd.Series(s.doc_ids.copy()).astype("Int64")
    return ids.mask(s.null.astype(bool))


def token_files(docs: DataFrame, path: str, folder: str, end_id: int | None = END_ID) -> None:
    """Encode ``doc_id``, ``text`` of ``docs`` and write them to ``folder``.

    Texts are read twice but never shuffled; their ids are. Null text is empty (the end id alone), a null doc_id comes
    first, repeated ids lie side by side; other columns are not looked at; no rows make no segments.
    """
    bounds = id_bounds(docs, partitions(docs))
    write_token_files(encoded_ids(spread(docs.select("doc_id", "text")), path, end_id), bounds, folder)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-files")
    token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(spark, folder)
