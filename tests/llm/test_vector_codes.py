from __future__ import annotations

import hashlib

import numpy as np
import pytest

from stmtgauge.llm import queries, vector_codes
from stmtgauge.llm.vector_codes import ball_nearest, nearest


def by_hand(rows, entries=256, rounds=4):
    """{vec_id: (code, error)} and the codebooks of [(vec_id, vector)], in Python's integers."""
    whole = {i: [(lambda n, d: 1024 * n // d)(*float(x).as_integer_ratio()) for x in v] for i, v in rows}
    width = len(next(iter(whole.values()))) // 4
    ids, codes, error, books = sorted(whole), dict.fromkeys(whole, ""), dict.fromkeys(whole, 0), []
    for p in range(4):
        part = {i: whole[i][p * width : p * width + width] for i in ids}
        c = [part[i] for i in ids[:entries]]
        far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
        for turn in range(rounds + 1):
            at = {i: min(range(len(c)), key=lambda e, i=i: (far(part[i], c[e]), e)) for i in ids}
            if turn < rounds:
                for e in range(len(c)):
                    own = [part[i] for i in ids if at[i] == e]
                    if own:
                        c[e] = [sum(x) // len(own) for x in zip(*own)]
        books.append(c)
        for i in ids:
            codes[i] += f"{at[i]:02x}"
            error[i] += far(part[i], c[at[i]])
    text = ",".join(str(v) for c in books for e in c for v in e)
    return {i: (codes[i], error[i]) for i in ids}, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("kind", [np.float64, np.int64, object])
def test_balls_find_what_all_entries_give(kind):
    draw = np.random.default_rng(3)
    centres = draw.integers(-900, 900, (40, 5))
    x = (centres[draw.integers(0, 40, 600)] + draw.integers(-30, 30, (600, 5))).astype(kind)
    for c in (centres, draw.integers(-3, 3, (60, 5)), np.zeros((4, 5), int)):
        at, far = nearest(x, c.astype(kind))
        near, d, work = ball_nearest(x, c.astype(kind), draw.integers(0, len(c), 600))
        assert (near == at).all() and (d == far).all()
        near, d, again = ball_nearest(x, c.astype(kind), at)
        assert (near == at).all() and (d == far).all()
    assert ball_nearest(x, centres.astype(kind), nearest(x, centres.astype(kind))[0])[2] < 600 * 5  # mostly stable cores


@pytest.mark.parametrize("scale", [1.0, 2e4, 2e5])
def test_rounds_equal_a_plain_loop(spark, scale):
    draw = np.random.default_rng(4)
    rows = [(int(i), (scale * draw.normal(size=8)).astype(float).tolist()) for i in draw.permutation(120)]
    rows += [(500, rows[0][1]), (501, [0.0] * 8)]
    want, digest = by_hand(rows, 16)
    given = [(i, v, i % 3 if i % 7 else None) for i, v in rows] + [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("inf")] * 8, 2)]
    df = spark.createDataFrame(given, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label BIGINT").selectExpr("*", "1 AS codes", "'x' AS error")
    coded, books = vector_codes.vector_codes(df.repartition(3), entries=16)
    out = vector_codes.with_label_error(coded).collect()
    assert {r.vec_id: (r.code, r.error) for r in out} == want and vector_codes.digest(books) == digest
    total = {k: sum(want[i][1] for i, _, label in given if label == k and i in want) for k in (0, 1, 2, None)}
    assert all(r.label_error == total[r.label] for r in out)


def test_odd_tables(spark):
    schema = "vec_id BIGINT, embedding ARRAY<FLOAT>, label STRING"
    rows = [(None, [1.0] * 4, "a"), (3, [2.0] * 4, "a"), (3, [1.0] * 4, None), (4, [5.0] * 6, None), (5, [], "b"), (None, [1.0] * 3, "b")]
    out = vector_codes.vector_codes(spark.createDataFrame(rows, schema))[0].collect()
    got = sorted(((r.vec_id, r.code, r.error) for r in out), key=str)
    near, far = 4 * (1365 - 1024) ** 2, 4 * (2048 - 1365) ** 2
    want = [(None, near), (3, far), (3, near), (4, 0), (5, 0)]
    assert got == sorted([*[(i, "00000000", e) for i, e in want], (None, None, None)], key=str)
    assert vector_codes.vector_codes(spark.createDataFrame([], schema))[0].collect() == []


def test_query_equals_a_plain_loop(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    want, digest = by_hand([(r.vec_id, r.embedding) for r in table])
    got = queries.op12_vector_codes(spark, "/root/testdata/sf0.001").collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}
