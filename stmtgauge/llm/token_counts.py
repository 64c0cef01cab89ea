"""Token counts of a byte-level BPE, by rank-synchronous array merging.

Texts are cut into pre-tokens by the vocabulary's pattern. The pre-tokens of a batch that were not counted before lie
in one flat numpy array of symbols, ragged by sequence. In each round every sequence finds the lowest rank among its
neighbouring pairs, and all sequences apply that pair of theirs at once; a sequence without a mergeable pair leaves.
What is left of it is its count. A merge never makes a pair of lower rank than its own (a merged symbol is younger than
its parts), so that all places of the lowest pair of a sequence may be merged in the same round.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.llm.common import schema_with, spread, table, texts_of, with_columns

LIMIT = 512
#: Pre-tokens a worker remembers, and the longest of them; both bound its memory, results do not depend on them.
REMEMBERED, REMEMBERED_CHARS = 400_000, 48
#: Pre-tokens whose counts are asked for together.
BATCH_TOKENS = 1 << 19


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files (fixed by their format)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merges of a vocabulary file as sorted arrays, for lookups of many pairs at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.base = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            self.base[byte] = vocab[char]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.none = len(keys)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``none`` if there is no merge) and its place in ``made``."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], self.none), at

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each sequence after all merges."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        counts = lengths.copy()
        symbols = self.base[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        # Rank and place in ``made`` of the pair that begins at each symbol; those next to a merge are looked up anew.
        rank, at = np.full(len(symbols), self.none), np.zeros(len(symbols), np.int64)
        changed = np.arange(len(symbols))
        while len(symbols):
            pairs = changed[(changed >= 0) & (changed < len(symbols) - 1)]
            rank[pairs], at[pairs] = self.find(symbols[pairs], symbols[pairs + 1])
            last = np.r_[owner[1:] != owner[:-1], True]
            rank[last] = self.none
            first = np.r_[0, np.flatnonzero(last)[:-1] + 1]
            size = np.diff(np.r_[first, len(symbols)])
            low = np.minimum.reduceat(rank, first)
            done = low >= self.none
            counts[owner[first[done]]] = size[done]
            # In a run of overlapping places (as in "aaaa") every second one merges, from the left.
            places = np.flatnonzero((rank < self.none) & (rank == np.repeat(low, size)))
            start = np.r_[True, np.diff(places) > 1][: len(places)]
            run = np.maximum.accumulate(np.where(start, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
            symbols[places] = self.made[at[places]]
            stay = ~np.repeat(done, size)
            stay[places + 1] = False
            moved = (np.cumsum(stay) - 1)[places]
            changed = np.concatenate([moved, moved - 1])
            symbols, owner, rank, at = symbols[stay], owner[stay], rank[stay], at[stay]
        return counts


@lru_cache(maxsize=4)
def _merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts tokens of texts; remembers the counts of short pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.merges = _merges(path)
        self.pattern = regex.compile(pattern)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def _learn(self, asked: Iterable[list[str]]) -> dict[str, int]:
        """Counts of what is not known yet; long pre-tokens are known for this batch only."""
        new = [t for t in {t for tokens in asked for t in tokens} if t not in self.known]
        counts = self.merges.count([t.encode() for t in new]).tolist() if new else []
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            return dict(zip(new, counts))
        self.known.update((t, n) for t, n in zip(new, counts) if len(t) <= REMEMBERED_CHARS)
        return {t: n for t, n in zip(new, counts) if len(t) > REMEMBERED_CHARS}

    def count(self, texts: Iterable[str]) -> Iterator[int]:
        pending: list[tuple[int, list[str]]] = []
        held = 0
        for text in texts:
            pieces = self.special.split(text) if self.special and "<|" in text else [text]
            tokens = [t for piece in pieces for t in self.pattern.findall(piece)]
            pending.append((len(pieces) - 1, tokens))
            held += len(tokens)
            if held >= BATCH_TOKENS:
                yield from self._counted(pending)
                pending, held = [], 0
        yield from self._counted(pending)

    def _counted(self, pending: list[tuple[int, list[str]]]) -> Iterator[int]:
        before = None
        extra = self._learn(tokens for _, tokens in pending)
        known = self.known
        for special, tokens in pending:
            try:
                yield special + sum(map(known.__getitem__, tokens))
            except KeyError:
                if before is None:
                    before = True
                    lost = {t for _, ts in pending for t in ts if t not in known and t not in extra}
                    extra |= dict(zip(lost, self.merges.count([t.encode() for t in lost]).tolist()))
                yield special + sum(known[t] if t in known else extra[t] for t in tokens)


def token_counts(
    docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to each row; columns of these
    names are replaced.

    ``path`` is a byte-level BPE file of the tokenizers library, present on every executor. Special strings inside a
    text are one token each, as is that library's default. Null text counts as empty: 0 bytes, 0 tokens. Rows are
    independent: repeated rows give repeated results, an empty table an empty one. No shuffle; a worker holds one
    Arrow batch and a bounded memory of pre-tokens.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    kept = docs.select(*[c for c in docs.columns if c not in added])
    schema = schema_with(kept, n_bytes="bigint", n_tokens="bigint", over_limit="boolean")

    def run(batches):
        counter = Counter(path, pattern)
        for batch in batches:
            raw = list(texts_of(batch, text))
            n = np.fromiter(counter.count(t.decode() for t in raw), np.int64, len(raw))
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            yield with_columns(
                batch, {"n_bytes": pa.array(size), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}
            )

    return kept.mapInArrow(run, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text"))
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
