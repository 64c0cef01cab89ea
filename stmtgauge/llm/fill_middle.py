"""Fill-in-middle: each text cut in three and put in another order, with a learned index of its code points.

A cut is asked for as a number of code points and made in UTF-8 bytes. The offsets of all code point boundaries of a text
are a rising curve; error-bounded straight segments are fitted to it, and what each boundary is off its segment is stored
in one byte. An offset is then predicted from the segment of its rank and made exact by the stored residual.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.llm.common import schema_with, spread, table, with_columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many stay plain, and so many of the others have the suffix first.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
#: A boundary is at most so many bytes off its segment, which one byte can hold.
ERROR = 31
_FIRST, _PACK = 1 << 10, 8 << 20


class RankIndex:
    """Byte offset of every code point boundary of a UTF-8 text: segments, and a residual for each boundary."""

    def __init__(self, text: bytes, error: int = ERROR):
        raw = np.frombuffer(text, np.uint8)
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).astype(np.int64)
        self.size = len(at) - 1
        self.first, self.base, self.slope = self._segments(at, error)
        self.residual = (at - self._predicted(np.arange(len(at)))).astype(np.int8)

    @staticmethod
    def _segments(at: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segment starts on its first boundary and goes on while one slope stays within ``error`` of all boundaries."""
        first, slope, start, block = [], [], 0, _FIRST
        while start < len(at):
            low, high, end = 0.0, np.inf, start + 1
            while end < len(at):
                steps = np.arange(end - start, min(end + block, len(at)) - start)
                rise = at[start + steps] - at[start]
                lows = np.maximum(np.maximum.accumulate((rise - error) / steps), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / steps), high)
                out = np.flatnonzero(lows > highs)
                fit = int(out[0]) if len(out) else len(steps)
                if fit:
                    low, high = float(lows[fit - 1]), float(highs[fit - 1])
                end += fit
                if len(out):
                    break
                block *= 2
            first.append(start)
            slope.append(low if np.isinf(high) else (low + high) / 2)
            start, block = end, max(_FIRST, min(block, 2 * (end - start)))
        first = np.array(first, np.int64)
        return first, at[first], np.array(slope)

    def _predicted(self, rank: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[s] + np.floor(self.slope[s] * (rank - self.first[s]) + 0.5).astype(np.int64)

    def offsets(self, rank: list[int]) -> list[int]:
        """Byte offsets after so many code points each."""
        rank = np.asarray(rank, np.int64)
        return (self._predicted(rank) + self.residual[rank]).tolist()


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document; a null id counts as no digits."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(found[i : i + 4], "big") for i in range(0, 16, 4)]


def transformed(doc_id: int | None, text: bytes, seed: int, marks: tuple[bytes, ...]) -> tuple[bytes, str, int, int | None, int | None]:
    """Output, form, code points in all, in the prefix and in the middle."""
    index = RankIndex(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    n = index.size
    if not n or h3 % 100 >= PLAIN_FROM or any(m in text for m in marks):
        return text, "plain", n, None, None
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = index.offsets([one, two])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h4 % 100 < SUFFIX_FIRST_BELOW:
        return b"".join((s, suffix, p, prefix, m, middle)), "spm", n, one, two - one
    return b"".join((p, prefix, s, suffix, m, middle)), "psm", n, one, two - one


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)
) -> DataFrame:
    """Add ``output``, ``form`` (plain, psm, spm), ``n``, ``prefix_chars`` and ``middle_chars`` to every row; columns of these
    names are replaced.

    ``marks`` open prefix, suffix and middle. A text that is empty or holds a mark stays plain, and so does a share of the
    others; null counts as empty and its output is empty too. Cuts fall between code points, also of very long texts;
    each row is taken by its id and ``seed`` alone, so repeated rows give equal outputs and ties need no rule. An empty
    table stays empty. No shuffle.
    """
    added = ("output", "form", "n", "prefix_chars", "middle_chars")
    kept = docs.select(*[c for c in docs.columns if c not in added or c in (doc_id, text)])
    kept = kept.withColumn("__id", F.col(doc_id).cast("bigint")).withColumn("__text", F.col(text).cast("string"))
    drop = ("__id", "__text", *added)
    shown = kept.select(*[c for c in kept.columns if c not in drop])
    schema = schema_with(shown, output="string", form="string", n="bigint", prefix_chars="bigint", middle_chars="bigint")
    raw = tuple(m.encode() for m in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, rows, held = 0, [], 0
            texts = batch.column("__text").cast(pa.large_binary())
            for i, (ident, t) in enumerate(zip(batch.column("__id").to_pylist(), texts)):
                rows.append(transformed(ident, t.as_py() or b"", seed, raw))
                held += len(rows[-1][0])
                if held > _PACK:
                    yield packed(batch.slice(done, len(rows)), rows)
                    done, rows, held = i + 1, [], 0
            if rows or not batch.num_rows:
                yield packed(batch.slice(done, len(rows)), rows)

    def packed(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
        columns[0] = columns[0].cast(pa.string())
        return with_columns(batch, dict(zip(added, columns)), drop)

    return kept.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made of: marks are looked for from the left, as no part of such a text holds one."""
    p, s, m = marks

    def parts(opening: str, next_: str) -> tuple[Column, Column, Column]:
        after = lambda c, n: F.substring(c, n + 1, F.length(output))
        body = after(F.col(output), F.lit(len(opening)))
        one = F.substring_index(body, next_, 1)
        rest = after(body, F.length(one) + len(next_))
        two = F.substring_index(rest, m, 1)
        return one, two, after(rest, F.length(two) + len(m))

    prefix, suffix, middle = parts(p, s)
    suffix_, prefix_, middle_ = parts(s, p)
    return (
        F.when(F.col(form) == "plain", F.col(output))
        .when(F.col(form) == "psm", F.concat(prefix, middle, suffix))
        .otherwise(F.concat(prefix_, middle_, suffix_))
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text"))
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )


#: The same by string functions over code points.
OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST(length(t) AS BIGINT) AS n,
    {", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM}
    THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
        ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
