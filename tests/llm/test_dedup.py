from __future__ import annotations

import numpy as np
import pytest

from stmtgauge.llm import common, components, embedding_dedup, queries, simhash, substring
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id BIGINT, text STRING"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]


def test_components_of_chain_star_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (500, 501), (501, 500)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a BIGINT, b BIGINT")
    got = {r.node: r.component for r in components.components(df).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {500: 500, 501: 500}
    assert got == want
    assert components.components(df.limit(0)).collect() == []


def test_simhash_query_equals_brute_force(spark):
    want = brute.simhash(documents(spark))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, DIR).collect()}
    assert got == want


def test_simhash_edges_of_input(spark):
    long = "word " * 200_000
    rows = [(5, None), (2, ""), (9, " \n\t"), (3, "One two"), (4, "one TWO"), (None, "one two"), (7, long), (7, long),
            (None, "nobody else says this at all")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS fp", "2 AS root", "3 AS id")
    got = sorted(((r.doc_id, r.component_id, r.fingerprint) for r in simhash.simhash_groups(df).collect()), key=str)
    by_id = {(i, c) for i, c, _ in got}
    assert by_id == {(5, 2), (2, 2), (9, 2), (3, 3), (4, 3), (None, 3), (7, 7), (None, None)}
    assert len(got) == len(rows) and all(f == "0" * 16 for i, c, f in got if c == 2)
    kept = simhash.one_of_each_group(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 2), (False, 3), (False, 7), (True, 0)]
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp", "root", "id"}
    assert simhash.simhash_groups(df.limit(0)).collect() == []


@pytest.mark.parametrize("split", [200_000, 60])
def test_gray_index_finds_all_links(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", split)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    noisy = [base]
    for k in range(1, 7):
        at = base[rng.integers(0, 30 if k % 2 else 2, 150)]
        for _ in range(k):
            at = at ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
        noisy.append(at)
    fps = np.unique(np.concatenate(noisy))
    want = brute.closure(list(range(len(fps))), np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    first = simhash.GrayIndex(np.zeros(len(fps), int), fps).connect()
    groups = {}
    assert all(groups.setdefault(want[i], f) == f for i, f in enumerate(first.tolist()))
    assert len(groups) == len(set(first.tolist()))
    signed = fps.view(np.int64).tolist()
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp BIGINT, id BIGINT")
    got = {r.fp: r.root for r in simhash.fingerprint_components(df).collect()}
    assert got == {signed[i]: c for i, c in want.items()}


def test_dense_group_costs_little():
    rng = np.random.default_rng(5)
    flips = [np.uint64(1) << rng.integers(0, 48, 60_000, dtype=np.uint64) for _ in range(5)]
    fps = np.unique(np.uint64(0x123456789ABCDEF0) ^ np.bitwise_or.reduce(flips, axis=0))
    assert len(set(simhash.GrayIndex(np.zeros(len(fps), int), fps).connect().tolist())) <= 20


@pytest.mark.parametrize("threshold", [0.93, 0.7])
def test_embedding_links_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(0)
    rows = [(i, v, int(k)) for i, (v, k) in enumerate(zip(rng.normal(size=(300, 6)).tolist(), rng.integers(0, 3, 300)))]
    rows += [(1000 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 6, 1), (2002, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (2009, [], 1),
             (2003, [float("nan")] + [1.0] * 5, 1), (2004, rows[0][1], None), (2005, [1e-200] * 6, 0),
             (2006, [1e-190] * 6, 0), (2007, [1.0, 2.0], 1), (2008, [1.0, 2.0], 1), (2010, [float("inf")] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT").selectExpr("*", "1 AS cell", "2 AS id")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, threshold).collect()}
    assert got == brute.embedding_links(rows, threshold)


def test_embedding_query_and_nothing(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op1_embedding_dedup(spark, DIR).collect()}
    assert got == brute.embedding_links(rows, 0.93)
    df = spark.createDataFrame([(None, [1.0], 1), (3, [1.0], 1), (3, [1.0], 1)], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == [(3, 1, 3, True), (3, 1, 3, True), (None, 0, None, True)]
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_substring_query_equals_brute_force(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_substring_dedup(spark, DIR).collect()}
    assert got == brute.without_repeats(documents(spark))


def test_substring_edges_of_input(spark, monkeypatch):
    monkeypatch.setattr(substring, "RANGE_BYTES", 300)
    monkeypatch.setattr(substring, "BUCKET_HASHES", 5)
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(i, f"own{i} {passage}\n  end{i} x{i}") for i in (8, 3, 5)] + [(1, None), (2, ""), (4, "short " + passage[:30])]
    rows += [(6, "a " * 40), (7, "b " + "a " * 60), (9, " ".join(f"q{i % 500}" for i in range(30_000)))]
    df = spark.createDataFrame([*rows, (None, passage)], DOCS).selectExpr("*", "1 AS n_words", "2 AS part", "'z' AS row")
    cut = substring.without_repeats(df).collect()
    want = brute.without_repeats(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in cut if r.doc_id is not None} == want
    text = {r.doc_id: r.text for r in cut}
    assert text[3] == rows[1][1] and text[8] == "own8 end8 x8" and text[1] is None and text[None] == passage
    assert cut[0].row == "z" and cut[0].part == 2
    same = spark.createDataFrame([(1, passage), (1, passage)], DOCS)
    assert [r.n_removed for r in substring.without_repeats(same, with_text=False).collect()] == [0, 0]
    assert substring.without_repeats(df.limit(0)).collect() == []


def test_ranges_are_even_however_many(spark, monkeypatch):
    df = spark.range(0, 30_000, 3).withColumnRenamed("id", "doc_id")
    for coarse, parts in ((1000, 20), (4, 20), (1000, 1)):
        monkeypatch.setattr(common, "COARSE", coarse)
        bounds = common.id_bounds(df, parts)
        sizes = [r["count"] for r in df.groupBy(common.range_of(bounds).alias("p")).count().collect()]
        assert abs(len(sizes) - parts) <= 1 and max(sizes) <= 1.5 * 10_000 / parts
    assert len(common.id_bounds(df.limit(0), 20)) == 0
