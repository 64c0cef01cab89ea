"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding at places where the pattern can never match across: between a character that is no
white space and a white space. Every alternative of the pattern that takes a non-space ends before the next white space,
and no alternative looks back, so that pieces encode to the ids of the whole. Each piece is bounded unless a text has a
longer stretch of characters that are no white space.

A run of white space is one match, without its last character where text follows. A long run has no boundary inside, and
the library's pattern matcher would nest as deep as it is long; so it is cut out by hand and its bytes are merged as the
one piece they are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.llm.common import schema_with, spread, table, texts_of, with_columns

#: Characters after which the next safe boundary ends a piece.
PIECE_CHARS = 1 << 16
#: White space characters in a row from which a run is cut out.
RUN_CHARS = 1 << 14
_BOUNDARY = regex.compile(r"(?<=\S)(?=\s)")
_PACK = 1 << 18


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The rank file as a tiktoken encoding without special tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries, each piece the shortest of at least ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = _BOUNDARY.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(text: str, enc: tiktoken.Encoding, size: int = PIECE_CHARS, run: int = RUN_CHARS) -> list[int]:
    """Ids of a text of any length and kind; texts of at most ``size`` characters go to the library as they are."""
    if len(text) <= size:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for found in regex.finditer(rf"(?<!\s)\s{{{run},}}", text):
        end = found.end() - (found.end() < len(text))
        out += [i for piece in pieces(text[at : found.start()], size) for i in enc.encode_ordinary(piece)]
        out += enc._encode_single_piece(text[found.start() : end])
        at = end
    return out + [i for piece in pieces(text[at:], size) for i in enc.encode_ordinary(piece)]


def decode(ids: list[int], enc: tiktoken.Encoding) -> bytes:
    """Raw bytes of the ids; they need not be valid UTF-8 when the ids are a part of a text."""
    return enc.decode_bytes(ids)


def encoded(
    docs: DataFrame,
    path: str,
    text: str = "text",
    pattern: str = public_tokenizers.PATTERN,
    with_ids: bool = True,
) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``with_ids``, ``ids`` (array of int) to each row;
    columns of these names are replaced.

    ``ids_sha256`` is of the decimal ids joined by one space, ``decoded_sha256`` of the bytes decoded from the ids.
    Null text is empty: no ids, digests of nothing; a text may be of any length, also of nothing but white space. Rows are independent, so repeated rows and ties need no rule; an
    empty table stays empty. No shuffle.
    """
    added = ("n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []))
    kept = docs.select(*[c for c in docs.columns if c not in added])
    ids_type = {"ids": "array<int>"} if with_ids else {}
    schema = schema_with(kept, n_tokens="bigint", ids_sha256="string", decoded_sha256="string", **ids_type)

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            done, n, shas, raws, held = 0, [], [], [], []
            tokens = 0
            for raw in texts_of(batch, text):
                ids = encode(raw.decode(), enc)
                n.append(len(ids))
                shas.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                raws.append(hashlib.sha256(decode(ids, enc)).hexdigest())
                tokens += len(ids)
                if with_ids:
                    held.append(pa.array(ids, pa.int32()))
                if with_ids and tokens > _PACK:
                    yield _packed(batch.slice(done, len(n)), n, shas, raws, held)
                    done, n, shas, raws, held, tokens = done + len(n), [], [], [], [], 0
            if n or not batch.num_rows:
                yield _packed(batch.slice(done, len(n)), n, shas, raws, held if with_ids else None)

    return kept.mapInArrow(run, schema)


def _packed(batch: pa.RecordBatch, n, shas, raws, held) -> pa.RecordBatch:
    added = {
        "n_tokens": pa.array(n, pa.int64()),
        "ids_sha256": pa.array(shas, pa.string()),
        "decoded_sha256": pa.array(raws, pa.string()),
    }
    if held is not None:
        ends = [0]
        for x in n:
            ends.append(ends[-1] + x)
        values = pa.concat_arrays(held) if held else pa.array([], pa.int32())
        added["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    return with_columns(batch, added)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text"))
    out = encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
