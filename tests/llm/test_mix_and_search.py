from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stmtgauge.llm import line_quality, mixing, order, queries, sharding, topk
from stmtgauge.sources.storage import materialize
from tests.llm import brute
from tests.llm.test_near_copies import jaccard_groups

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id BIGINT, text STRING, source STRING"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "w " * 50_000, None), (None, "one two", "b"), (4, "x y z", "b"),
            (4, "x y z", "b"), (5, " \n ", "c"), (6, "p q", None)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "2 AS rank", "3 AS s", "4 AS target", "5 AS `__row`")


def test_running_sums_cross_tasks(spark):
    rows = [(g, (i * 7919) % 1000, i % 13) for g in (0, 1) for i in range(500 if g else 1000)]
    df = spark.createDataFrame(rows, "g BIGINT, o INT, w BIGINT")
    got = {(r.g, r.o): (r.rank, r.before) for r in order.running(df, "g", ["o"], "w").collect()}
    for g in (0, 1):
        total = 0
        for n, (_, o, w) in enumerate(sorted(x for x in rows if x[0] == g)):
            assert got[g, o] == (n, total)
            total += w


def test_shards_hold_the_mixture(spark, docs):
    rows = queries.op4_sharding(spark, DIR).collect()
    assert Counter(r.law for r in rows) == {"rows": len(docs)}
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))
    per_source = defaultdict(Counter)
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), None)
        per_source[docs[r.doc_id].source][r.shard] += 1
    for c in per_source.values():
        assert max(c.values()) - min(c[k] for k in range(8)) <= 2
    again = {(r.doc_id, r.shard, r.slot) for r in queries.op4_sharding(spark, DIR).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_shards_of_odd_rows(spark, odd):
    rows = sharding.interleaved_shards(odd, 3).collect()
    assert Counter(r.shard for r in rows) == {0: 3, 1: 3, 2: 2} and len(rows) == 8
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(1, 0)}
    assert sharding.interleaved_shards(odd.limit(0)).collect() == []


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        rest -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def check_mix(rows, source_of, text_of):
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r.size == len(brute.words(text_of[r.doc_id])) and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        sizes[source_of[r.doc_id]] += r.size
        taken[source_of[r.doc_id]] += r.taken
    target = fill(sizes)
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
    return target, taken


def test_mix_meets_targets(spark):
    larger = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    rows = queries.op2_mixing(spark, larger).collect()
    target, taken = check_mix(rows, {i: d.source for i, d in docs.items()}, {i: d.text for i, d in docs.items()})
    assert all(abs(target[s] - taken[s]) <= 0.01 * target[s] for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op2_mixing(spark, larger).collect()))


def test_mix_of_capped_sources_and_odd_rows(spark, odd):
    rows = [(i, "w " * (i % 9 + 1), "abc"[i % 3] if i < 90 else None) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(df).collect()
    target, taken = check_mix(got, {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows})
    assert taken["a"] == target["a"] == 3 * sum(i % 9 + 1 for i in range(0, 90, 3))
    assert all(abs(target[s] - taken[s]) <= 1 for s in target)
    got = mixing.mixed(odd).collect()
    assert len(got) == 8 and all(r.taken == r.copies * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (1, 2, 5)} == {0}
    assert mixing.mixed(odd.limit(0)).collect() == []
    assert mixing.mixture(odd).columns == odd.columns


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("longest", [4_500, 2_500])
def test_mix_passes_over_a_very_long_document(spark, seed, longest):
    rng = np.random.default_rng(seed)
    sizes = {("b", 0): longest} | {("b", i): int(rng.integers(30, 70)) for i in range(1, 111)} | {("a", i): 50 for i in range(900, 990)}
    df = spark.createDataFrame([(i, "w " * n, s) for (s, i), n in sizes.items()], DOCS)
    rows = [r for r in mixing.mixed(df, seed=seed).collect() if r.source == "b"]
    left = min(r.size for r in rows if not r.copies)
    assert 0 < rows[0].target < rows[0].source_size and abs(sum(r.taken for r in rows) - rows[0].target) < left


def test_heavier_documents_come_more_often():
    assert mixing.quality(b"Plain words, as they come.") > mixing.quality(b"@@ ## $$ 123") >= mixing.LEAST_WEIGHT
    assert mixing.quality(b"") == mixing.LEAST_WEIGHT and mixing.quality(b"a\na\na") < mixing.quality(b"a\nb\nc")


def best(vectors, queries_, k):
    out = []
    for q, x in queries_:
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q and len(x) == len(y))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket", [1024, 16])
def test_top_products_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3 * bucket)
    monkeypatch.setattr(topk, "SEED_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 17)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) * rng.lognormal(size=(300, 1))
    x[:30] = np.round(x[:30])  # ties
    x[50:60] = x[40]
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(900, [0.0] * 5), (901, [1.0, 2.0]), (902, [2.0, 1.0]), (800, None),
            (801, [float("nan")] * 5), (802, [None] * 5), (803, [float("inf")] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>").selectExpr("*", "1 AS id", "2 AS v", "3 AS norm")
    got = topk.top_products(df, df.where("vec_id % 10 = 0 OR vec_id IN (901, 55)"))
    sound = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows if i is not None and i < 800 or i in (900, 901, 902)]
    want = best(sound, [r for r in sound if r[0] % 10 == 0 or r[0] in (901, 55)], 10)
    assert sorted(map(tuple, got.collect())) == want
    assert topk.top_products(df.limit(0), df).collect() == [] and topk.top_products(df, df.limit(0)).collect() == []


@pytest.mark.parametrize("axis", [-1.0, 1.0])
def test_coordinate_bounds_keep_what_lies_at_the_axis(axis):
    rng = np.random.default_rng(7)
    v = np.round(1000 * (np.eye(6)[0] * axis * 3 + rng.normal(size=(400, 6)) * rng.choice([0.0, 0.05, 1.0], size=(400, 1)))).astype(np.int64)
    v = v[np.argsort(-(v**2).sum(axis=1))].astype(np.float64)
    bucket = topk.Bucket(v)
    score = v[:60] @ v.T
    for place in (3, 10, 50):
        floor = np.sort(score, axis=1)[:, -place]
        query, row, product = bucket.hits(v[:60], floor)
        assert set(zip(query, row)) == set(zip(*np.nonzero(score >= floor[:, None]))) and (product == score[query, row]).all()


@pytest.mark.parametrize("size", [2.0**20, 2.0**30, 2.0**36])
def test_large_components_take_part(spark, size):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 3)) * np.where(rng.random((80, 1)) < 0.3, min(size, 2.0**19), 1.0)
    x[:6] *= 0
    x[:6, 0] = [size, -size, size / 2, 1.0, size / 4, -1.0]
    x = x if size < 2.0**30 else np.clip(x, -(2.0**19), 2.0**19)
    x[6] = [0.5 / size, 0, 0] if size > 2.0**30 else x[6]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    whole = [(i, [(lambda n, d: 1024 * n // d)(*c.as_integer_ratio()) for c in v]) for i, v in rows]
    asked = [r for r in whole if r[0] % 3 == 0] if size <= 2.0**20 else [r for r in whole if r[0] in (3, 5, 6, 9)]
    got = topk.top_products(df, df.where(F.col("vec_id").isin([i for i, _ in asked])))
    assert sorted(map(tuple, got.collect())) == best(whole, asked, 10)


def test_products_beyond_bigint_fail_the_query(spark):
    df = spark.createDataFrame([(1, [1e300]), (2, [1e300]), (3, [1.0])], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="leaves BIGINT"):
        topk.top_products(df, df).collect()


def test_top_products_query_equals_its_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    want = sorted(duckdb.sql(queries.SQL["op8_top_products"]).fetchall())
    assert sorted(map(tuple, queries.op8_top_products(spark, DIR).collect())) == want


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lengths, steps = np.array([3, 0, 4, 1]), rng.normal(size=(2, 2))
    unary = rng.normal(size=8)
    good, expected = line_quality.marginals(unary, lengths, steps)
    at = 0
    for d, n in enumerate(lengths):
        total, p, e = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[at + i] * y[i] for i in range(n)) + sum(steps[a, b] for a, b in zip(y, y[1:])))
            total, p = total + w, p + w * np.array(y, float)
            for a, b in zip(y, y[1:]):
                e[a, b] += w
        assert np.allclose(p / total, good[at : at + n]) and np.allclose(e / total, expected[d])
        at += n


def test_long_chains_equal_short_ones():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 100, 5000):
        unary, steps = 4 * rng.normal(size=n), rng.normal(size=(2, 2))
        assert np.allclose(line_quality.marginals(unary, np.array([n]), steps)[0], line_quality.long_marginals(unary, steps))


def test_features_in_parts_are_the_same():
    text = b"\n".join(rng_line.encode() for rng_line in (["Some line, of words.", "", "AAA || !!", "x"] * 9)[:-1])
    whole = np.concatenate([x for x, _ in line_quality.feature_parts(text, 1000)])
    for size in (1, 2, 3, 7, 35, 36):
        parts = list(line_quality.feature_parts(text, size))
        assert (np.concatenate([x for x, _ in parts]) == whole).all() and max(len(x) for x, _ in parts) <= size + 1
        assert np.concatenate([c for _, c in parts]).tolist() == [len(x) for x in text.split(b"\n")]
    assert whole.shape == (35, line_quality.FEATURES) and not list(line_quality.feature_parts(b""))


def test_a_document_of_very_many_lines():
    model = line_quality.Model(np.linspace(-1, 1, line_quality.FEATURES), np.eye(2), 1.0, 0.0, 0.5)
    text = b"\n".join(b"line %d of a long text, with words" % (i % 1000) for i in range(200_000))
    score = line_quality._scores(model, [line_quality._unary(model, t) for t in (b"short one", text, b"")])
    assert score.shape == (3,) and (score >= 0).all() and score[2] == 0.5


def test_quality_is_learnt(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op10_line_quality(spark, d).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)
    assert [tuple(r) for r in queries.op10_line_quality(spark, d).orderBy("doc_id").collect()] == sorted(map(tuple, rows))


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (9, None), (None, 1)], "doc_id BIGINT, quality INT")
    for known in (labels, labels.limit(0)):
        model = line_quality.fit(odd, known)
        rows = line_quality.scored(odd.selectExpr("*", "'x' AS score"), model).collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if not r.text}) == 1
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
        assert line_quality.scored(odd.limit(0), model).collect() == []


def test_pipeline_stages_do_what_they_say(spark, docs):
    given = spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("*", "1 AS score", "'x' AS fp", "2 AS n_words", "3 AS row")
    seen, df = [], given
    for _, stage in corpus_pipeline.STAGES:
        before = df
        df = materialize(stage(spark, df, DIR))
        seen.append((before, df))
    assert all(b.columns == a.columns == given.columns for b, a in seen[:-1])
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = set(ids(seen[0][1]))
    right = [(i in kept) == (q == 1) for i, q in label.items()]
    assert sum(right) >= 0.9 * len(right)
    groups = jaccard_groups([(r.doc_id, r.text) for r in seen[1][0].collect()])
    assert sorted(ids(seen[1][1])) == sorted(set(groups.values()))
    want = brute.without_repeats([(r.doc_id, r.text) for r in seen[2][0].collect()])
    cut = seen[2][1].collect()
    assert {r.doc_id: len(brute.words(r.text)) for r in cut} == {i: n - gone for i, (n, gone, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in cut)
    takes = Counter(ids(seen[3][1]))
    assert takes == {r.doc_id: r.copies for r in mixing.mixed(seen[3][0]).collect() if r.copies}
    assert Counter(ids(seen[4][1])) == takes
    final = sorted(map(tuple, seen[4][1].drop("ids").collect()), key=str)
    assert final == sorted(map(tuple, corpus_pipeline.run(spark, DIR).drop("ids").collect()), key=str)
