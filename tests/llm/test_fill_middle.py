from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from stmtgauge.llm import fill_middle, queries
from stmtgauge.llm.fill_middle import RankIndex

DIR = "/root/testdata/sf0.001"


def by_hand(doc_id, text):
    """The contract over Python strings: n, form, prefix, middle, output."""
    t = text or ""
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@pytest.fixture(scope="module")
def odd():
    draw = random.Random(5)
    letters = "ab é漢🙂<PSM>\x00\n"
    texts = ["", "x", "🙂", "<P>", "a<S>b", "<", "<S", "<M<P", "é" * 70_000 + "a" * 70_000 + "🙂漢" * 30_000, "a" * 300_000]
    return texts + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 90))) for _ in range(500)]


def test_index_gives_every_offset(odd):
    for t in odd[:40]:
        index = RankIndex(t.encode())
        ends = np.concatenate([[0], np.cumsum([len(c.encode()) for c in t])]).astype(int).tolist()
        assert index.size == len(t) and index.offsets(list(range(len(t) + 1))) == ends
        assert np.abs(index.residual.astype(int)).max() <= fill_middle.ERROR + 1
    assert len(RankIndex(("é" * 50_000).encode()).first) == 1 and len(RankIndex(b"a" * 50_000).first) == 1


def test_outputs_and_what_they_restore_to(spark, odd):
    rows = [*enumerate(odd), (None, "nobody's text"), (7, None), (7, odd[7])]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "'z' AS n", "1 AS form", "2 AS __text")
    out = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored()).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.back == (r.text or "")
        if r.doc_id is not None:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).collect() == []


def test_query_on_given_documents(spark):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_fill_middle(spark, DIR).collect()}
    want = {i: (lambda n, f, p, m, o: (n, f, p, m, digest(o), digest(t or "")))(*by_hand(i, t)) for i, t in text.items()}
    assert got == want
