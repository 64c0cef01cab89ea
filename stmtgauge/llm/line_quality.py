"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of characters and words, repetition, and the same of the lines before
and after it; the chain adds how likely a good line follows a good or a bad one. Forward-backward gives each line's
probability of being good given the whole document; weighted by the lines' lengths these make the document's quality,
which a logistic curve turns into the probability that its label is 1.

Only documents are labelled: in training all lines of a document bear its label.
"""

from __future__ import annotations

import math
import operator
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.llm.common import schema_with, spread, table, texts_of, with_columns

#: Labelled documents that are learnt from, and the most lines such a document may have.
SAMPLE_DOCS, SAMPLE_LINES = 4000, 200
FOLDS, KEEP_FROM = 5, 0.3
#: Lines whose features are held at once, and lines from which a document's chain is run in blocks.
PART_LINES, LONG_LINES = 1 << 14, 1 << 11
STEPS, RATE, DECAY = 250, 0.08, 1e-3

_UPPER, _LOWER, _DIGIT = (s.encode() for s in (string.ascii_uppercase, string.ascii_lowercase, string.digits))
_HIGH, _PLAIN, _SPACE = bytes(range(128, 256)), b".,;:'\"-()?", b" \t\r\x0b\x0c"
_BASE, _SHARED = 24, 7
FEATURES = _BASE + 2 * (1 + _SHARED)


def _line(line: bytes, seen: set[bytes]) -> list[float]:
    n = len(line)
    if not line.strip():
        return [1.0, 0.0, *[0.0] * (_BASE - 3), 1.0]
    size = 1.0 / n
    without = lambda chars: n - len(line.translate(None, chars))
    upper, lower, digit, high = without(_UPPER), without(_LOWER), without(_DIGIT), without(_HIGH)
    plain, space = without(_PLAIN), without(_SPACE)
    odd = (n - upper - lower - digit - high - plain - space) * size
    words = line.split()
    w = len(words)
    again = sum(map(operator.eq, words, words[1:])) / w
    distinct = len(set(words)) / w
    shout, bar = line.count(b"!") * size, line.count(b"|") * size
    case = upper / max(1, upper + lower)
    copy = float(line in seen)
    seen.add(line)
    return [
        1.0, np.log1p(n) / 5, case, digit * size, high * size, plain * size, odd, shout, bar, again, distinct,
        (n - space) / w / 10, copy, float(case > 0.3), float(case > 0.7), float(odd > 0.02), float(odd > 0.1),
        float(again > 0.05), float(again > 0.3), float(bar > 0.01), float(shout > 0.02), float(plain == 0),
        float(n < 20), 0.0,
    ]


#: Features of a line that its neighbours see: letter case, odd characters, "!", "|", repeated words, copies, blank.
_SEEN = [2, 6, 7, 8, 9, 12, 23]


def feature_parts(text: bytes, size: int = PART_LINES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature rows and lengths of a text's lines, ``size`` lines at a time; an empty text has no lines."""
    lines = text.split(b"\n") if text else []
    seen: set[bytes] = set()
    none = np.zeros((1, 1 + _SHARED), np.float32)
    own, last = np.empty((0, _BASE), np.float32), none
    shared = np.empty((0, 1 + _SHARED), np.float32)
    for at in range(0, len(lines) + 1, size):
        # A line is written once the one after it is known.
        fresh = np.array([_line(x, seen) for x in lines[at : at + size]], np.float32).reshape(-1, _BASE)
        own = np.concatenate([own, fresh])
        shared = np.concatenate([shared, np.c_[np.ones(len(fresh), np.float32), fresh[:, _SEEN]]])
        end = at + size > len(lines)
        n = len(own) - (not end)
        if n > 0:
            after = np.concatenate([shared[1 : n + 1], none])[:n]
            before = np.concatenate([last, shared[: n - 1]])
            first = at + len(fresh) - len(own)
            yield np.c_[own[:n], before, after], np.array([len(x) for x in lines[first : first + n]], np.float64)
            own, last, shared = own[n:], shared[n - 1 : n], shared[n:]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and lengths of all lines of a text."""
    parts = list(feature_parts(text))
    if not parts:
        return np.empty((0, FEATURES), np.float32), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*parts))


# -- the chain -------------------------------------------------------------------------------------------------------
def marginals(unary: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good of each line, and per document the expected number of each of the four steps.

    ``unary``: log-odds of good of all lines, documents one after the other; ``lengths``: their numbers of lines, none 0;
    ``steps``: 2 x 2 log-weights of a step from one state to the next. All documents move along together.
    """
    order = np.argsort(-lengths, kind="stable")
    size, start = lengths[order], (np.cumsum(lengths) - lengths)[order]
    top = np.maximum(unary, 0)
    own = np.exp(np.stack([-top, unary - top], axis=1))
    move = np.exp(steps - steps.max())
    forward, scale = np.empty_like(own), np.ones(len(own))
    longest = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]
    for t in range(longest):
        at = start[: active[t]] + t
        a = own[at] if t == 0 else (forward[at - 1] @ move) * own[at]
        scale[at] = a.sum(axis=1)
        forward[at] = a / scale[at][:, None]
    backward = np.ones_like(own)
    expected = np.zeros((len(lengths), 2, 2))
    for t in range(longest - 1, 0, -1):
        at = start[: active[t]] + t
        ahead = own[at] * backward[at] / scale[at][:, None]
        backward[at - 1] = ahead @ move.T
        expected[order[: active[t]]] += forward[at - 1][:, :, None] * move * ahead[:, None, :]
    return (forward * backward)[:, 1], expected


def long_marginals(unary: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Probability of good of each line of one long document, as ``marginals`` gives it.

    The chain is cut into about as many blocks as they have lines. A block is a product of 2 x 2 matrices; all blocks are
    multiplied out together, then chained, and then run through together again from what comes before and after each.
    """
    top = np.maximum(unary, 0)
    own = np.exp(np.stack([-top, unary - top], axis=1))
    move, n = np.exp(steps - steps.max()), len(unary) - 1
    width = max(1, math.isqrt(n))
    blocks = -(-n // width)
    step = np.broadcast_to(np.eye(2), (blocks * width, 2, 2)).copy()  # steps beyond the end change nothing
    step[:n] = move[None] * own[1:, None, :]
    step = step.reshape(blocks, width, 2, 2)
    whole = np.broadcast_to(np.eye(2), (blocks, 2, 2))
    for i in range(width):
        whole = whole @ step[:, i]
        whole = whole / whole.max(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((blocks, 1, 2)), np.empty((blocks, 2, 1))
    now = own[:1]
    for b in range(blocks):
        ahead[b] = now
        now = now @ whole[b]
        now = now / now.sum()
    now = np.ones((2, 1))
    for b in range(blocks - 1, -1, -1):
        behind[b] = now
        now = whole[b] @ now
        now = now / now.sum()
    forward, backward = np.empty((blocks, width, 2)), np.empty((blocks, width, 2))
    for i in range(width):
        ahead = ahead @ step[:, i]
        ahead = ahead / ahead.sum(axis=2, keepdims=True)
        forward[:, i] = ahead[:, 0]
    for i in range(width - 1, -1, -1):
        backward[:, i] = behind[:, :, 0]
        behind = step[:, i] @ behind
        behind = behind / behind.sum(axis=1, keepdims=True)
    both = np.concatenate([own[:1] * now.T, (forward * backward).reshape(-1, 2)[:n]])
    return both[:, 1] / both.sum(axis=1)


@dataclass
class Model:
    """What was learnt; of fixed size."""

    weights: np.ndarray
    steps: np.ndarray
    slope: float
    offset: float
    prior: float

    def quality(self, unary: np.ndarray, lengths: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Length-weighted mean probability of good of each document, from its lines' log-odds; NaN without lines."""
        long = lengths >= LONG_LINES
        good = np.empty(len(unary))
        in_long = np.repeat(long, lengths)
        good[~in_long] = marginals(unary[~in_long], lengths[~long], self.steps)[0]
        start = np.cumsum(lengths) - lengths
        for i in np.flatnonzero(long):
            here = slice(start[i], start[i] + lengths[i])
            good[here] = long_marginals(unary[here], self.steps)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        weight = chars + 1
        with np.errstate(invalid="ignore"):
            return np.bincount(doc, good * weight, len(lengths)) / np.bincount(doc, weight, len(lengths))

    def score(self, unary: np.ndarray, lengths: np.ndarray, chars: np.ndarray) -> np.ndarray:
        q = _odds(self.quality(unary, lengths, chars))
        return np.where(lengths > 0, 1 / (1 + np.exp(-np.clip(self.slope * q + self.offset, -30, 30))), self.prior)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def train(x: np.ndarray, lengths: np.ndarray, chars: np.ndarray, label: np.ndarray) -> Model:
    """Maximum conditional likelihood with both labels of equal weight; the same for the same input."""
    prior = float(label.mean()) if len(label) else 0.5
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, _odds(np.array([prior]))[0], prior)
    weight = np.where(label == 1, 0.5 / max(prior, 1e-9), 0.5 / max(1 - prior, 1e-9))
    y, w = np.repeat(label, lengths).astype(float), np.repeat(weight / np.sqrt(np.maximum(1, lengths)), lengths)
    pairs = np.maximum(0, lengths - 1)
    step_weight = weight / np.sqrt(np.maximum(1, lengths))
    seen = np.zeros((2, 2))
    for s in (0, 1):
        seen[s, s] = (pairs * step_weight)[label == s].sum()
    total = w.sum()
    params = np.zeros(FEATURES + 4)
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for i in range(1, STEPS + 1):
        steps = params[FEATURES:].reshape(2, 2)
        good, expected = marginals(x @ params[:FEATURES], lengths, steps)
        slope = np.r_[x.T @ (w * (y - good)), (seen - np.tensordot(step_weight, expected, 1)).ravel()] / total
        slope -= DECAY * params
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        params = params + RATE * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.999**i)) + 1e-8)
    model = Model(params[:FEATURES], params[FEATURES:].reshape(2, 2), 1.0, 0.0, prior)
    some = lengths > 0
    q, t = _odds(model.quality(x @ model.weights, lengths, chars)[some]), label[some]
    a = b = 0.0
    for _ in range(50):  # Newton steps of a logistic curve, lightly held back
        p = 1 / (1 + np.exp(-(a * q + b)))
        v = p * (1 - p) + 1e-6
        g = np.array([(q * (t - p)).sum() - 0.1 * a, (t - p).sum() - 0.1 * b])
        h = np.array([[(v * q * q).sum() + 0.1, (v * q).sum()], [(v * q).sum(), v.sum() + 0.1]])
        da, db = np.linalg.solve(h, g)
        a, b = a + da, b + db
    return Model(model.weights, model.steps, float(a), float(b), prior)


# -- over tables -----------------------------------------------------------------------------------------------------
def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text is divisible by five; false for null."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from at most ``SAMPLE_DOCS`` labelled documents that are not held out, chosen by a hash of their ids, as far
    as they have at most ``SAMPLE_LINES`` lines. Their features, a bounded array, come to the driver."""
    named = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out("doc_id"))
    named = named.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            out = []
            for i, q, t in zip(batch["doc_id"].to_pylist(), batch["quality"].to_pylist(), texts_of(batch, "text")):
                if t.count(b"\n") < SAMPLE_LINES:
                    x, chars = features(t)
                    out.append((i, q, len(x), x.tobytes(), chars.tobytes()))
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(out, columns=["doc_id", "quality", "n", "x", "chars"]), preserve_index=False
            ) if out else pa.RecordBatch.from_pylist([], pa.schema(
                [("doc_id", pa.int64()), ("quality", pa.int64()), ("n", pa.int64()), ("x", pa.binary()), ("chars", pa.binary())]
            ))

    rows = texts.mapInArrow(run, "doc_id bigint, quality bigint, n bigint, x binary, chars binary").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.x))
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, FEATURES).astype(np.float64)
    chars = np.frombuffer(b"".join(r.chars for r in rows))
    return train(x, np.array([r.n for r in rows], np.int64), chars, np.array([r.quality for r in rows], np.int64))


def scored(docs: DataFrame, model: Model, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Add ``held_out``, ``score`` (probability of label 1) and ``predicted`` (1 from ``keep_from`` on) to each row;
    columns of these names are replaced.

    The whole text counts, and nothing but it. Null and empty texts have no lines and get the share of label 1 among the
    documents learnt from (0.5 if there were none). Equal texts score alike. A text of very many lines is read in parts and its
    chain run in blocks, in time and memory in proportion to its length. Rows are independent: no shuffle; an empty table
    stays empty.
    """
    added = ("held_out", "score", "predicted")
    kept = docs.select(*[c for c in docs.columns if c not in added])
    kept = kept.withColumn("held_out", held_out("doc_id"))

    def run(batches):
        for batch in batches:
            scores, held, n_lines = [], [], 0
            for t in texts_of(batch, text):
                held.append(_unary(model, t))
                n_lines += len(held[-1][0])
                if n_lines > 1 << 16:
                    scores.append(_scores(model, held))
                    held, n_lines = [], 0
            if held:
                scores.append(_scores(model, held))
            score = np.concatenate(scores) if scores else np.empty(0)
            predicted = (score >= keep_from).astype(np.int32)
            yield with_columns(batch, {"score": pa.array(score), "predicted": pa.array(predicted)})

    return kept.mapInArrow(run, schema_with(kept, score="double", predicted="int"))


def _unary(model: Model, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and lengths of a text's lines; features are held for some lines at a time."""
    parts = [(x.astype(np.float64) @ model.weights, chars) for x, chars in feature_parts(text)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0), np.empty(0))


def _scores(model: Model, held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    unary, chars = (np.concatenate(x) for x in zip(*held))
    return model.score(unary, np.array([len(u) for u, _ in held]), chars)


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(spread(docs), model).select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "score", "predicted")
