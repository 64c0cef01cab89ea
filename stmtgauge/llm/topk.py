"""Exact top-k inner products by norm-bucketed retrieval.

Vectors lie in buckets of similar length, longest first. The best products with a bounded set of the longest vectors give
each query a threshold that its k-th best product cannot be below. Divided by the query's length and the longest length
of a bucket it is the bucket's local cosine threshold: above 1 the bucket is skipped as a whole; if it is high, the
query's largest coordinates decide (a direction that is near enough must lie in a narrow interval of each of them); if
it is low, the vectors' own lengths do. What is left is verified by integer products.

Queries and vectors meet in pairs of blocks: a query goes to every block of vectors whose longest one can reach its
threshold, and each pair of a block of queries and one of vectors is a task of bounded size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stmtgauge.llm.common import materialize, spread, table
from stmtgauge.llm.order import running

K, SCALE, EVERY = 10, 1024, 100
#: Vectors that give the first thresholds, vectors in a bucket, vectors and queries in a block, and blocks of vectors at
#: most: beyond that blocks grow.
SEED_ROWS, BUCKET_ROWS, BLOCK_ROWS, QUERY_ROWS, BLOCKS = 2048, 1024, 4096, 16_384, 4096
#: Local cosine threshold from which coordinates prune better than lengths, and coordinates looked at.
COORDINATE_FROM, FOCUS = 0.5, 4
#: Queries that are looked up in a bucket together.
_STEP = 256
_SLACK = 1e-9


def kind_of(largest: float, size: int):
    """Number type in which products of ``size`` components of at most ``largest`` are exact."""
    top = (SCALE * largest + 1) ** 2 * max(1, size) if largest < 1e100 else math.inf
    return np.float64 if top < 2**53 else np.int64 if top < 2**63 else object


def whole(x: np.ndarray, kind) -> np.ndarray:
    """floor(1024 x) of every component."""
    if kind is object:
        floor = lambda v: (lambda n, d: SCALE * n // d)(*float(v).as_integer_ratio())
        return np.array([floor(v) for v in x.ravel()], object).reshape(x.shape)
    return np.floor(SCALE * x).astype(kind)


class Bucket:
    """Vectors of similar length, longest first, with their directions."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.length = vectors, np.sqrt((vectors**2).sum(axis=1))
        self.longest = float(self.length.max())
        self.direction = (vectors / np.where(self.length == 0, 1.0, self.length)[:, None]).T

    def hits(self, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, row) whose product reaches the floor of the query, and the products."""
        length = np.sqrt((queries**2).sum(axis=1))
        prunes = (floor > 0) & (length > 0)
        reach = np.where(prunes, length * self.longest, 1.0)
        local = np.where(prunes, floor / np.where(reach > 0, reach, floor / 2), -np.inf)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        sharp = np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + _SLACK))
        for at in range(0, len(sharp), _STEP):
            q = sharp[at : at + _STEP]
            i, row = np.nonzero(self._inside(queries[q] / length[q, None], local[q]))
            found.append((q[i], row, (queries[q[i]] * self.vectors[row]).sum(axis=1)))
        blunt = np.flatnonzero(local < COORDINATE_FROM)
        for at in range(0, len(blunt), _STEP):
            q = blunt[at : at + _STEP]
            # Rows too short for every one of these queries are the end of the bucket.
            least = np.where(prunes[q], floor[q] * (1 - _SLACK) / np.where(prunes[q], length[q], 1.0), 0.0).min()
            some = int((self.length >= least).sum())
            score = queries[q] @ self.vectors[:some].T
            i, row = np.nonzero(score >= floor[q, None])
            found.append((q[i], row, score[i, row]))
        query, row, score = (np.concatenate(x) for x in zip(*found))
        good = score >= floor[query]
        return query[good], row[good], score[good]

    def _inside(self, unit: np.ndarray, local: np.ndarray) -> np.ndarray:
        """For each query which directions lie in the intervals of its largest coordinates.

        cos(q, v) >= c bounds each coordinate of v: between q_f c -+ sqrt((1 - c^2)(1 - q_f^2)), or q_f -+ the same where that
        reaches farther (v may lie between q and the axis).
        """
        focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        at = np.take_along_axis(unit, focus, axis=1)
        wide = np.sqrt(np.maximum(0.0, 1 - local * local)[:, None] * np.maximum(0.0, 1 - at**2)) + _SLACK
        low, high = np.minimum(at, at * local[:, None]) - wide, np.maximum(at, at * local[:, None]) + wide
        inside = np.ones((len(unit), self.direction.shape[1]), bool)
        for f in range(focus.shape[1]):
            x = self.direction[focus[:, f]]
            inside &= (x >= low[:, f, None]) & (x <= high[:, f, None])
        return inside


def best(queries: np.ndarray, names: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query id, vector id, product) of the k best vectors of each query but itself, ties to the smaller id. Vectors are
    sorted, longest first; no product below a query's ``floor`` is among its best."""
    query, row, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, queries.dtype)
    floor = floor.copy()
    for at in range(0, len(vectors), BUCKET_ROWS):
        part = vectors[at : at + BUCKET_ROWS]
        if queries.dtype == np.float64:
            q, r, s = Bucket(part).hits(queries, floor)
        else:  # beyond the doubles nothing is pruned
            s = queries @ part.T
            q, r = (x.ravel() for x in np.indices(s.shape))
            s = s.ravel()
        other = names[q] != ids[at + r]
        query, row, score = (np.concatenate(x) for x in ((query, q[other]), (row, at + r[other]), (score, s[other])))
        order = np.lexsort((ids[row], -score, query)) if score.dtype != object else _ordered(ids[row], score, query)
        head = np.flatnonzero(np.r_[True, query[order][1:] != query[order][:-1]]) if len(order) else np.empty(0, np.int64)
        place = np.arange(len(order)) - np.repeat(head, np.diff(np.r_[head, len(order)]))
        keep = order[place < k]
        query, row, score = query[keep], row[keep], score[keep]
        last = place[place < k] == k - 1
        if queries.dtype == np.float64:
            floor[query[last]] = np.maximum(floor[query[last]], score[last])
    return names[query], ids[row], score


def _ordered(ids: np.ndarray, score: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.array(sorted(range(len(ids)), key=lambda i: (query[i], -score[i], ids[i])), np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """Rows of equally many components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return whole(values.reshape(len(column), -1) if len(values) else np.empty((len(column), 0)), kind)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by number of components."""
    for size in pc.unique(batch.column("size")).to_pylist():
        yield size, batch.filter(pc.equal(batch.column("size"), size))


def _with_floor(asked: DataFrame, longest: DataFrame, kind, k: int) -> DataFrame:
    """Add ``floor``, the k-th best product of a query with the longest vectors; where these are fewer, nothing is known."""
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in longest.collect():  # bounded: SEED_ROWS
        seeds.setdefault(r.size, ([], []))[0].append(r.id)
        seeds[r.size][1].append(r.v)
    seeds = {n: (np.array(i), whole(np.array(v, np.float64).reshape(len(i), n), kind)) for n, (i, v) in seeds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _parts(batch):
                floor = np.full(part.num_rows, -np.inf)
                if kind is np.float64 and size in seeds and len(seeds[size][0]) > k:
                    ids, x = seeds[size]
                    score = _matrix(part.column("v"), kind) @ x.T
                    score[part.column("id").to_numpy()[:, None] == ids[None, :]] = -np.inf
                    floor = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                yield part.append_column("floor", pa.array(floor))

    return asked.mapInArrow(run, "id bigint, size int, v array<double>, norm double, floor double")


def top_products(vectors: DataFrame, queries: DataFrame, k: int = K, column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: for each row of ``queries`` the k best of ``vectors`` but
    itself, by integer product of the components floor(1024 x); ties go to the smaller id; all, if there are fewer.

    Vectors that are null or hold null or non-finite components take no part, nor do rows of null id. Components may be of
    any size: the largest one, measured once, says whether doubles, 64-bit or Python's integers hold all products exactly;
    a product among the best that leaves BIGINT fails the query. Only vectors of equally many components meet; those
    without components score 0. Every row of a repeated id is a candidate for the others; of repeated query rows each id
    is asked once. Zero vectors score 0 like any other. Other columns are not looked at. No queries or no vectors give no
    rows.

    The driver sees the longest vectors and one row per block of vectors; queries stay in tasks. Each pair of blocks keeps
    k rows per query, and these are cut to k again before and after the last shuffle.
    """
    spark = vectors.sparkSession
    rows = materialize(_sound(spread(vectors, column), column), "vectors")
    asked = _sound(queries, column).dropDuplicates(["id"])
    stats = [F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.max("size"), F.count("*")]
    (m, width, n), (m2, width2, _) = rows.agg(*stats).first(), asked.agg(*stats).first()
    kind = kind_of(max(m or 0.0, m2 or 0.0), max(width or 0, width2 or 0))
    # Longest first: the seed thresholds and the blocks follow this order.
    longest = rows.orderBy(F.desc("norm"), "id").limit(SEED_ROWS)
    asked = materialize(_with_floor(asked, longest, kind, k), "queries")
    query_blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    block_rows = max(BLOCK_ROWS, math.ceil(n / BLOCKS))
    # Ranks within each number of components, so that a block holds vectors of one.
    order = {"__size": F.col("size").cast("bigint"), "__far": -F.col("norm"), "__one": F.lit(1).cast("bigint")}
    placed = running(rows.withColumns(order), "__size", ["__far", "id"], "__one")
    block = F.floor(F.col("rank") / block_rows).cast("int").alias("block")
    placed = materialize(placed.select("id", "size", "v", "norm", block), "blocks")
    known = placed.groupBy("size", "block").agg(F.sqrt(F.max("norm")).alias("longest")).collect()
    # One constant, so that the plan stays small.
    blocks = F.from_json(F.lit(json.dumps([r.asDict() for r in known])), "array<struct<size:int,block:int,longest:double>>")
    reached = F.filter(
        blocks,
        lambda b: (b["size"] == F.col("size"))
        & ((F.col("floor") <= 0) | (b["longest"] * F.sqrt("norm") >= F.col("floor") * (1 - _SLACK))),
    )
    query_block = F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("query_block")
    left = asked.select("id", "v", "floor", "size", query_block, F.explode(reached).alias("b"))
    left = left.select("id", "v", "floor", "size", "b.block", "query_block")
    every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block")
    right = placed.select("id", "v", "norm", "size", "block", every)

    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64),) * 3
        if len(queries) and len(vectors):
            vectors = vectors.sort_by([("norm", "descending"), ("id", "ascending")])
            asked = _matrix(queries["v"], kind), queries["id"].to_numpy(), queries["floor"].to_numpy()
            found = best(*asked, _matrix(vectors["v"], kind), vectors["id"].to_numpy(), k)
            if kind is object and any(abs(s) >= 1 << 63 for s in found[2]):
                raise OverflowError("a product of vectors leaves BIGINT")
        return pa.table([pa.array(c.astype(np.int64)) for c in found], ["query_id", "vec_id", "score"])

    keys = ["size", "block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sound(vectors: DataFrame, column: str) -> DataFrame:
    """``id``, ``size``, ``v`` and ``norm``, the sum of squares of floor(1024 x); what takes no part is left out."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = vectors.where("vec_id IS NOT NULL").select(
        F.col("vec_id").cast("bigint").alias("id"), F.size(column).alias("size"), F.col(column).cast("array<double>").alias("v")
    )
    floor = lambda x: F.when(F.abs(x) < F.lit(2.0**50), F.floor(F.lit(float(SCALE)) * x).cast("double")).otherwise(SCALE * x)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + floor(x) * floor(x))
    return rows.where(F.col("v").isNotNull() & finite).withColumn("norm", norm)


def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the rows whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    found = top_products(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
    return found.select("query_id", "rank", "vec_id", "score")


#: The same rows by comparing every query with every vector; sums of whole doubles below 2^53 are exact.
OP8_SQL = f"""
WITH v AS (
    SELECT vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.v, v.v) AS BIGINT) AS score
    FROM v AS q JOIN v ON q.vec_id % {EVERY} = 0 AND v.vec_id <> q.vec_id AND len(q.v) = len(v.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
