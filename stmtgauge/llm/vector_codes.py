"""Vector code compression: product quantization whose codebooks are fitted by ball k-means.

An entry's ball holds the parts that lie with it; its radius is the farthest of them. Only entries within twice the radius
are neighbours of the ball, and a part ``d`` away from its entry can only move to neighbours at most ``2 d`` away from that
entry. So parts nearer than half the way to the nearest neighbour form the stable core, which needs no work, and the
others lie in rings around the entry, each with the first so many neighbours as its exact candidates. Everything is
whole numbers, so bounds and ties are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.llm.common import schema_with, small, spread, table, with_columns, written
from stmtgauge.sources.storage import remove

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest component whose products are exact in doubles and in 64-bit integers; beyond it Python's integers are used.
_DOUBLE, _LONG = 1 << 23, 1 << 27
#: Parts of a ring that are compared together, and parts compared with all entries at once in the first round.
_RING, _STEP = 64, 4096

#: Entries of a part position, by (components of the vector, part position).
Codebooks = dict[tuple[int, int], np.ndarray]


def kind_of(largest: int, width: int):
    """Number type in which squared distances of ``width`` components of at most ``largest`` are exact."""
    room = max(1, width) / 16
    return np.float64 if largest * room**0.5 <= _DOUBLE else np.int64 if largest * room**0.5 <= _LONG else object


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``c``."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every part (ties: the lower one) and its squared distance, by comparing with all entries."""
    at, far = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
    for i in range(0, len(x), _STEP):
        d = _squares(x[i : i + _STEP], c)
        at[i : i + _STEP] = np.argmin(d, axis=1)
        far[i : i + _STEP] = d[np.arange(len(d)), at[i : i + _STEP]]
    return at, far


def ball_nearest(x: np.ndarray, c: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``nearest``, starting from the entry that ``held`` each part before; also the number of distances computed."""
    at = held.copy()
    own = x - c[held]
    far = (own * own).sum(axis=1)
    apart = _squares(c, c)
    work = len(x)
    order = np.argsort(held, kind="stable")
    balls, first = np.unique(held[order], return_index=True)
    for ball, members in zip(balls, np.split(order, first[1:])):
        reach = 4 * far[members]
        # Neighbours of the ball, nearest first; an entry just twice the radius away may tie.
        around = np.flatnonzero(apart[ball] <= reach.max())
        around = around[around != ball]
        around = around[np.argsort(apart[ball][around], kind="stable")]
        ring = np.searchsorted(apart[ball][around], reach, side="right")
        moving = members[ring > 0]  # the others are the stable core
        if not len(moving):
            continue
        ring = ring[ring > 0]
        by_ring = np.argsort(ring, kind="stable")
        for i in range(0, len(moving), _RING):
            some, rings = moving[by_ring[i : i + _RING]], ring[by_ring[i : i + _RING]]
            candidates = np.sort(np.append(around[: rings[-1]], ball))
            # Entries beyond a part's own ring are farther than its ball's, so the whole block may look at the widest one.
            d = _squares(x[some], c[candidates])
            work += d.size
            best = np.argmin(d, axis=1)
            at[some] = candidates[best]
            far[some] = d[np.arange(len(some)), best]
    return at, far, work


def _rows(vectors: DataFrame, vec_id: str, column: str, label: str) -> DataFrame:
    """``vec_id``, ``label`` and ``v``, whose components are not null and finite."""
    given = "array<float>" if dict(vectors.dtypes)[column] == "array<float>" else "array<double>"
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(column).cast(given).alias("v")
    )
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return rows.where(F.col("v").isNotNull() & sound)


def _floors(x: np.ndarray, kind) -> np.ndarray:
    if kind is object:
        floor = lambda v: (lambda n, d: SCALE * n // d)(*float(v).as_integer_ratio())
        return np.array([floor(v) for v in x.ravel()], object).reshape(x.shape)
    return np.floor(SCALE * x).astype(kind)


def _cut(x: np.ndarray) -> list[np.ndarray]:
    return np.array_split(x, PARTS, axis=1)


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their values as a matrix, apart by length."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values, start = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[start[rows][:, None] + np.arange(size)]


def _start(rows: DataFrame, entries: int) -> tuple[Codebooks, type]:
    """Entries from the smallest ids of each number of components; one row of a repeated id, its least vector."""
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    stats = rows.groupBy(F.size("v").alias("size")).agg(largest.alias("m")).collect()  # a row per number of components
    kinds = [np.float64, np.int64, object]
    kind = max((kind_of(int(SCALE * (r.m or 0.0)) + 1, -(-r.size // PARTS)) for r in stats), key=kinds.index, default=np.float64)
    books: Codebooks = {}
    for r in stats:
        of_size = rows.where((F.size("v") == r.size) & F.col("vec_id").isNotNull())
        first = of_size.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
        x = np.array([list(f.v) for f in first], np.float64).reshape(len(first), r.size)
        books |= {(r.size, p): part for p, part in enumerate(_cut(_floors(x, kind)))}
    return books, kind


def _assigned(rows: DataFrame, books: Codebooks, kind) -> DataFrame:
    """Each vector with its ``codes`` and ``error``, the squared distances of its parts; without entries both are null."""
    first = "codes" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = np.full((batch.num_rows, PARTS), -1, np.int64), [None] * batch.num_rows
            if not first:
                for at, held in _lists(batch.column("codes")):
                    codes[at] = held
            for at, x in _lists(batch.column("v")):
                if not len(books[x.shape[1], 0]):
                    continue
                far = 0
                for p, part in enumerate(_cut(_floors(x.astype(np.float64), kind))):
                    c = books[x.shape[1], p]
                    codes[at, p], d = nearest(part, c) if first else ball_nearest(part, c, codes[at, p])[:2]
                    far = far + d
                for i, e in zip(at, far):
                    error[i] = str(int(e))
            flat = pa.array(codes.ravel().astype(np.int16))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * PARTS, pa.int32()), flat)
            yield with_columns(batch, {"codes": listed, "error": pa.array(error, pa.string())}, ("codes", "error"))

    kept = rows.drop("codes", "error")
    return rows.mapInArrow(run, schema_with(kept, codes="array<smallint>", error="string"))


def _updated(coded: DataFrame, books: Codebooks, kind) -> Codebooks:
    """Entries after a round: componentwise floor of the mean of their parts. Sums are made per task, then over tasks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            held = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS)
            for at, x in _lists(batch.column("v")):
                for p, part in enumerate(_cut(_floors(x.astype(np.float64), kind))):
                    c, own = books[x.shape[1], p], held[at, p]
                    n, s = total.setdefault((x.shape[1], p), (np.zeros(len(c), np.int64), np.zeros(c.shape, object)))
                    order = np.argsort(own, kind="stable")
                    used, first = np.unique(own[order], return_index=True)
                    n += np.bincount(own, minlength=len(c))
                    if part.shape[1]:
                        found = np.add.reduceat(part[order], first, axis=0)
                        s[used] += found if kind is object else found.astype(np.int64).astype(object)
        some = [(*k, int(e), int(n[e]), [str(v) for v in s[e]]) for k, (n, s) in total.items() for e in np.flatnonzero(n)]
        for i in range(0, len(some), _STEP):
            columns = zip(*some[i : i + _STEP])
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["size", "part", "entry", "n", "s"])

    of_tasks = coded.where("codes[0] >= 0").select("v", "codes")
    of_tasks = of_tasks.mapInArrow(sums, "size int, part int, entry int, n bigint, s array<string>")
    places = of_tasks.select("size", "part", "entry", "n", F.posexplode("s").alias("at", "s"))
    if kind is object:  # sums beyond any decimal
        add = F.udf(lambda found: str(sum(map(int, found))), "string")
        total = add(F.collect_list("s"))  # one value per task
    else:
        total = F.sum(F.col("s").cast("decimal(28,0)")).cast("string")
    met = places.groupBy("size", "part", "entry", "at").agg(F.sum("n").alias("n"), total.alias("s"))
    out = {k: c.copy() for k, c in books.items()}
    for r in met.collect():  # bounded: entries times components
        out[r.size, r.part][r.entry, r.at] = int(r.s) // r.n
    return out


def digest(books: Codebooks) -> str:
    """Of the decimal components by number of components, part, entry and position."""
    text = ",".join(str(int(v)) for k in sorted(books) for entry in books[k] for v in entry)
    return hashlib.sha256(text.encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """``vec_id``, ``label``, ``codes`` (array of entry numbers), ``code`` (two hex digits each) and ``error`` for every
    vector, and the codebooks.

    Components become floor(1024 x). Vectors that are null or hold null or non-finite components are left out. Vectors of
    another number of components have codebooks of their own; where it cannot be cut evenly, the first parts are one
    longer, and one without components has error 0. Codebooks start from the smallest ids, of a repeated id from its least
    vector; rows of null id are coded but start nothing, and where no row has an id codes are -1, code and error null.
    Every row counts in the means, repeated ones as often as they occur. Components of any size are exact; an error
    beyond BIGINT fails the query. Other columns are not looked at; an empty table gives no rows.

    Each round reads the vectors and their codes as written by the round before and writes them anew, so a lost executor
    costs its tasks alone; the table before is removed. The driver holds the codebooks only.
    """
    rows = _rows(vectors, vec_id, column, label)
    books, kind = _start(rows, entries)
    coded, before = spread(rows), None
    for turn in range(rounds + 1):
        coded, path = written(_assigned(coded, books, kind), "codes")
        if before:
            remove(vectors.sparkSession, before)
        before = path
        if turn < rounds:
            books = _updated(coded, books, kind)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("bigint")), 2, "0"))), "")
    code = F.when(F.col("error").isNotNull(), code)
    return coded.select("vec_id", "label", "codes", code.alias("code"), F.col("error").cast("bigint").alias("error")), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the sum of ``error`` over rows of equal label, null ones together."""
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(small(sums, sums.count(), 256), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    out = with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(books)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same with every part compared with every entry; sums of whole doubles below 2^53 are exact."""
    far = "list_dot_product(x, x) - 2 * list_dot_product(x, c.c) + list_dot_product(c.c, c.c)"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
    SELECT vec_id, label, s.p, any_value(x) AS x, arg_min(e, {far} + e / 1024.0) AS e, min({far}) AS d
    FROM s JOIN c{k} AS c USING (p) GROUP BY vec_id, label, s.p)""")
        if k < ROUNDS:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
    SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{k} AS c LEFT JOIN (
        SELECT p, e, list(floor(t / n) ORDER BY i) AS c FROM (
            SELECT p, e, i, sum(v) AS t, count(*) AS n
            FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e
    ) AS m ON m.p = c.p AND m.e = c.e)""")
    last = ROUNDS
    return f"""
WITH k AS (
    SELECT vec_id, label, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT vec_id, label, p, v[len(v) // {PARTS} * p + 1 : len(v) // {PARTS} * (p + 1)] AS x
    FROM k, (SELECT unnest(range({PARTS})) AS p)),
c0 AS (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM s
    QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {ENTRIES}),
{", ".join(steps)},
h AS (
    SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h
    FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM c{last})),
r AS (
    SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM a{last} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM r, h
"""


OP12_SQL = _sql()
