"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one kept vector per group.

Each label's vectors are assigned to cells by spherical k-means. Two vectors within the threshold may lie in two cells;
then each is no farther from the bisector of the two centroids than the threshold's angle. So a vector also visits the
cells of lower number whose bisector is that near, and is compared with the vectors at home there. No link is lost,
whatever the centroids. Cells are compared in blocks of bounded size, so a cell with a third of all vectors is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stmtgauge.llm.common import BROADCAST_BYTES, materialize, small, table
from stmtgauge.llm.components import components
from stmtgauge.llm.simhash import _union

THRESHOLD = 0.93
#: Vectors of a cell on average, and of a block. Cells grow beyond that where all centroids would exceed the size that may
#: be broadcast; blocks do not.
CELL_ROWS, BLOCK_ROWS = 1024, 2048
#: Vectors per label to which centroids are fitted, and rounds; every vector is assigned afterwards.
FIT_ROWS, ROUNDS = 4096, 12
_EPS = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Directions in double precision; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; starts from vectors far from each other, and is the same for the same input."""
    centroids = [x[0]]
    nearest = x @ x[0]
    for _ in range(1, k):
        centroids.append(x[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, x @ centroids[-1])
    c = np.array(centroids)
    for _ in range(rounds):
        home = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        c = np.where(length > 0, sums / np.where(length > 0, length, 1), c)
    return c


def _assigned(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and which cells it visits."""
    near = x @ c.T
    home = np.argmax(near, axis=1)
    apart = np.sqrt(np.maximum(0, ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)))[home]
    reach = math.sin(math.acos(threshold)) if threshold > 0 else math.inf
    visits = (near[np.arange(len(x)), home][:, None] - near) <= reach * apart + _EPS
    return home, visits & (np.arange(len(c)) < home[:, None])


def _compared(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside one pair of blocks: per vector their number and the smallest vector it is connected to here."""
    left, right = pdf[pdf["side"] != 1], pdf[pdf["side"] != 0]
    same = bool((pdf["side"] == 2).all())
    if not len(left) or not len(right):
        return pd.DataFrame({"id": [], "links": [], "root": []}, dtype=np.int64)
    x = np.frombuffer(b"".join(left["v"]), np.float64).reshape(len(left), -1)
    y = x if same else np.frombuffer(b"".join(right["v"]), np.float64).reshape(len(right), -1)
    near = x @ y.T >= threshold
    if same:
        np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    ids = left["id"].to_numpy() if same else np.r_[left["id"].to_numpy(), right["id"].to_numpy()]
    copies = left["copies"].to_numpy() if same else np.r_[left["copies"].to_numpy(), right["copies"].to_numpy()]
    b = b if same else b + len(left)
    links = np.bincount(a, copies[b], len(ids)).astype(np.int64)
    if not same:
        links += np.bincount(b, copies[a], len(ids)).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    label = _union(np.arange(len(ids)), place[a], place[b])
    linked = np.flatnonzero(links > 0)
    return pd.DataFrame({"id": ids[linked], "links": links[linked], "root": ids[order][label[place[linked]]]})


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", column: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``vectors``.

    Two rows are linked when their labels are equal and not null, they have as many components, and their cosine in
    double precision is ``threshold`` or more. ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id reachable, and the row that bears it is ``kept``. Null or zero vectors, those that hold null or
    non-finite components, and rows of null label or null id link with nothing: no links, themselves, kept. Equal
    vectors are compared once and counted as often as they occur; a repeated id is linked like another row. Other columns
    are not looked at. An empty table gives no rows.
    """
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v")
    )
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    some = F.exists("v", lambda x: x != 0)
    takes_part = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound & some, F.lit(False))
    rows = rows.withColumn("part", takes_part)
    unique = rows.where("part").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    unique = materialize(unique.withColumn("size", F.size("v")), "vectors")

    counts = unique.groupBy("label", "size").agg(F.count("*").alias("n"))
    n, width = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("size"), F.lit(1))).first()
    # A label of n vectors has fewer than 2 n / cell_rows cells.
    cell_rows = max(CELL_ROWS, math.ceil(2 * n * width * 8 / BROADCAST_BYTES))
    large = counts.where(F.col("n") > cell_rows).withColumn("k", F.ceil(F.col("n") / cell_rows).cast("int"))
    # The lowest hashes of a label: a bound on the hash leaves about twice as many, so that no task ranks a whole label.
    drawn = F.xxhash64("id").cast("double") < F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), 2.0 * FIT_ROWS / F.col("n"))
    by_hash = Window.partitionBy("label", "size").orderBy(F.xxhash64("id"), "id")
    few = unique.select("label", "size", "id").join(small(large, counts.count(), 256), ["label", "size"]).where(drawn)
    chosen = few.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= FIT_ROWS).select("id", "k")
    sample = unique.join(chosen, "id")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.array(pdf["v"].tolist(), np.float64))
        c = spherical_kmeans(x, min(int(pdf["k"].iloc[0]), max(1, len(x) // 4)))
        return pd.DataFrame({"id": pdf["id"].iloc[:1], "c": [c.tobytes()]})

    fitted = sample.groupBy("label", "size").applyInPandas(fit, "id bigint, c binary")
    # A label is known in tasks by the id of its first sampled vector. All centroids stay below BROADCAST_BYTES.
    known = unique.join(fitted, "id").select("label", "size", F.col("id").alias("g"), "c").collect()
    sent = vectors.sparkSession.sparkContext.broadcast({r.g: np.frombuffer(r.c).reshape(-1, r.size) for r in known})
    of = [(r.label, r.size, r.g) for r in known]
    named = vectors.sparkSession.createDataFrame(of, unique.select("label", "size", F.col("id").alias("g")).schema)
    placed = unique.join(small(named, len(of), 256), ["label", "size"], "left")
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (size, g), part in pdf.groupby(["size", "g"], dropna=False):
                x = unit(np.array(part["v"].tolist(), np.float64))
                c = None if pd.isna(g) else sent.value[int(g)]
                home, visits = (np.zeros(len(x), int), np.zeros((len(x), 1), bool)) if c is None else _assigned(x, c, threshold)
                guest, cell = np.nonzero(visits)
                at = np.r_[np.arange(len(x)), guest]
                yield pd.DataFrame(
                    {
                        "label_key": part["label_key"].to_numpy()[at],
                        "cell": np.r_[home, cell],
                        "guest": np.r_[np.zeros(len(x), bool), np.ones(len(guest), bool)],
                        "id": part["id"].to_numpy()[at],
                        "copies": part["copies"].to_numpy()[at],
                        "v": [x[i].tobytes() for i in at],
                    }
                )

    key = F.concat_ws("/", F.col("size").cast("string"), F.col("label").cast("string")).alias("label_key")
    cells = placed.select(key, "size", "g", "id", "copies", "v").mapInPandas(
        assign, "label_key string, cell int, guest boolean, id bigint, copies bigint, v binary"
    )
    cells = materialize(cells, "cells")
    sizes = cells.groupBy("label_key", "cell").agg(F.count_if(~F.col("guest")).alias("h"), F.count_if("guest").alias("w"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    sizes = sizes.select("label_key", "cell", blocks("h").alias("h"), blocks("w").alias("w"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("guest"), F.col("w")).otherwise(F.col("h"))).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda i, guests, j, side: F.struct(i.alias("i"), F.lit(guests).alias("guests"), j.alias("j"), side.alias("side"))
    side = lambda o: F.when(o == F.col("own"), 2).when(F.col("own") < o, 0).otherwise(1)
    at_home = F.concat(
        F.transform(upto("h"), lambda o: task(F.least(o, "own"), False, F.greatest(o, "own"), side(o))),
        F.transform(upto("w"), lambda o: task(F.col("own"), True, o, F.lit(0))),
    )
    as_guest = F.transform(upto("h"), lambda o: task(o, True, F.col("own"), F.lit(1)))
    dealt = (
        cells.join(small(sizes, sizes.count(), 64), ["label_key", "cell"])
        .withColumn("own", own)
        .select("label_key", "cell", "id", "copies", "v", F.explode(F.when(F.col("guest"), as_guest).otherwise(at_home)).alias("t"))
        .select("label_key", "cell", "id", "copies", "v", "t.*")
    )
    found = dealt.groupBy("label_key", "cell", "i", "guests", "j").applyInPandas(
        lambda pdf: _compared(pdf, threshold), "id bigint, links bigint, root bigint"
    )
    found = materialize(found, "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    done = (
        unique.join(links, "id", "left")
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    linked = rows.where("part").join(done, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT part").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
