from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from stmtgauge.llm import near_copies, simhash
from tests.llm import brute


def jaccard_groups(rows, words=5, least=0.8):
    """Smallest id reachable over links of shingle similarity, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = brute.words((t or "").lower())
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    near = np.array([[len(a & b) >= least * len(a | b) for b in sets] for a in sets])
    return brute.closure([i for i, _ in rows], near)


def changed(rng, words, places):
    words = list(words)
    for i in places:
        words[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def test_stage_equals_brute_force_jaccard(spark):
    rng = np.random.default_rng(1)
    base = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in (60, 200, 400)]
    rows = [(100 * k + i, changed(rng, b, rng.choice(len(b), i * len(b) // 600, replace=False))) for k, b in enumerate(base) for i in range(30)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one three"), (906, rows[0][1].upper())]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "1 AS __n", "2 AS __row", "3 AS n_chars")
    kept = corpus_pipeline.without_near_copies(spark, df, "")
    assert kept.columns == df.columns
    want = sorted(set(jaccard_groups(rows).values()))
    assert sorted(r.doc_id for r in kept.collect()) == want and 15 < len(want) < 90
    assert near_copies.one_of_each_group(df.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [7, 512])
def test_a_large_loose_group(spark, monkeypatch, parts):
    """Copies of one text with so many words changed that many are similar to some and not to others."""
    monkeypatch.setattr(near_copies, "PART_ROWS", parts)
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows, last = [], base
    for i in range(160):
        last = changed(rng, last, rng.choice(120, 2, replace=False)).split() if i % 40 else base  # chains away from the base
        rows.append((i, " ".join(last)))
        rows.append((1000 + i, changed(rng, base, rng.choice(120, int(rng.integers(0, 7)), replace=False))))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    want = sorted(set(jaccard_groups(rows).values()))
    assert sorted(r.doc_id for r in near_copies.one_of_each_group(df).collect()) == want and len(want) < 150


def test_overlaps_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 90, rng.integers(0, 60))) for _ in range(40)] + [np.arange(20_000)] * 2
    got = near_copies.overlaps(sets)
    shared = set(np.concatenate(sets)[:0]) | {x for i, s in enumerate(sets) for x in s if any(x in t for j, t in enumerate(sets) if j != i)}
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            assert got[i, j] == (len(set(s) & set(t)) if i != j else len(set(s) & shared))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_stage_on_given_documents(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    want = jaccard_groups([(r.doc_id, r.text) for r in df.collect()])
    kept = [r.doc_id for r in near_copies.one_of_each_group(df).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(want.values()))
    assert sf != "0.001" or {1, 6} <= set(kept) and not {145, 177} & set(kept)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f g"), (7, "A b c d e f g"), (7, "a b c d e f g"), (None, "nobody else says this at all")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert sorted(str(r.doc_id) for r in near_copies.one_of_each_group(df).collect()) == ["7", "None"]


def test_links_come_from_the_gray_order_index(spark, monkeypatch):
    """What the index does not bring together stays apart, whatever the texts; what it does is verified."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:-1], f"end{i}"])) for i in range(4)] + [(9, "nobody else says this")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, df, "").collect())
    assert kept() == [0, 9]
    nobody = lambda fps, *_: fps.selectExpr("id", "id AS key", "2L AS m").limit(0)
    monkeypatch.setattr(near_copies, "neighbourhoods", nobody)
    assert kept() == [0, 1, 2, 3, 9]
    everybody = lambda fps, *_: fps.selectExpr("id", "7L AS key", "5L AS m")
    monkeypatch.setattr(near_copies, "neighbourhoods", everybody)
    assert kept() == [0, 9]


@pytest.mark.parametrize("split", [40, 200_000])
@pytest.mark.parametrize("width", [12, 16])
def test_neighbourhoods_hold_all_near_pairs_and_no_others(spark, monkeypatch, split, width):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", split)
    rng = np.random.default_rng(4)
    base, rows = rng.integers(0, 2**64, (12, 3), np.uint64), []
    for i in range(240):
        noise = rng.integers(0, 2**64, (5, 3), np.uint64)
        rows.append(base[i % 12] ^ np.bitwise_and.reduce(noise[: rng.integers(2, 6)], axis=0))
    fps = np.array(rows)
    df = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(fps.view(np.int64).tolist())], "id BIGINT, fps ARRAY<BIGINT>")
    got = simhash.neighbourhoods(df.union(spark.sql("SELECT 1L, array()")), 241, 3, width, 10).collect()
    shared, members = set(), {}
    for r in got:
        members.setdefault(r.key, []).append(r.id - 1000)
    for r in got:
        assert len(members[r.key]) >= 2 and r.m % len(members[r.key]) == 0
    assert len({tuple(sorted(x)) for x in members.values()}) == len(members)
    diff = np.bitwise_count(fps[:, None] ^ fps[None, :])
    block = [(fps[:, None] ^ fps[None, :]) >> np.uint64(width * i) & np.uint64((1 << width) - 1) == 0 for i in range(64 // width)]
    near = ((diff <= 10) & np.any(block, axis=0)).any(axis=2)
    for ids in members.values():
        shared |= {(a, b) for a in ids for b in ids if a < b}
        seen = {ids[0]}  # each neighbourhood hangs together by near pairs
        while grown := {b for a in seen for b in ids if near[a, b]} - seen:
            seen |= grown
        assert seen == set(ids)
    wanted = {(a, b) for a in range(240) for b in range(a + 1, 240) if near[a, b]}
    assert wanted <= shared and 300 < len(wanted) < 240 * 239 / 4


@pytest.mark.parametrize("width, number", [x[1:] for x in near_copies.BLOCKS])
@pytest.mark.parametrize("common, one, two", [(4, 0, 1), (8, 1, 1), (80, 10, 10), (320, 40, 40), (320, 0, 80)])
def test_fingerprints_of_similar_sets_meet(width, number, common, one, two):
    """Sets of similarity 0.8 share a block and the radius in more fingerprints than a miss of all allows for."""
    rng, met, n = np.random.default_rng(5), 0, 40
    for _ in range(n):
        found = rng.integers(0, 2**64, common + one + two, np.uint64)
        a, b = found[: common + one], np.r_[found[:common], found[common + one :]]
        d = np.array(near_copies.fingerprints(a, number)).view(np.uint64) ^ np.array(near_copies.fingerprints(b, number)).view(np.uint64)
        same = np.any([d >> np.uint64(width * i) & np.uint64((1 << width) - 1) == 0 for i in range(64 // width)], axis=0)
        hits = (same & (np.bitwise_count(d) <= near_copies.NEAR)).sum()
        met += hits / n
        assert hits
    assert met > 6  # on average; no hit at all then has a probability of some e^-7 at most


def test_fingerprints_are_majorities():
    found = np.random.default_rng(6).integers(0, 2**64, 5000, np.uint64)
    for some in (found[:1], found[:7], found):
        got = np.array(near_copies.fingerprints(some, 3)).view(np.uint64)
        assert len(got) == (6 if len(some) <= near_copies.FEW else 3) and len(set(got.tolist())) == len(got)
        for fp, seed in zip(got, near_copies._SEEDS):
            h = some ^ seed
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            assert np.bitwise_count(fp) == sum(2 * int((h >> np.uint64(i) & np.uint64(1)).sum()) > len(some) for i in range(64))
    assert near_copies.fingerprints(found[:0], 3) == []


def test_sketches_never_rule_out_what_is_similar():
    rng, ruled_out = np.random.default_rng(7), 0
    for n in (1, 5, 63, 64, 90, 127, 500, 3000):
        for share in (0, 0.05, 0.1, 0.12, 0.3, 1):
            found = rng.integers(0, 2**64, 2 * n, np.uint64)
            a, b = found[:n], found[int(share * n) : n + int(share * n * rng.random())]
            both = len(np.intersect1d(a, b))
            least = near_copies.apart(near_copies.sketch(a), near_copies.sketch(b))
            assert least <= len(a) + len(b) - 2 * both
            row = {"key": 1, "low": 0, "high": 0}
            rows = [row | {"id": i, "n": len(x), "c": i, "sketch": near_copies.sketch(x)} for i, x in enumerate((a, b, a))]
            kept = near_copies._with_partner(pd.DataFrame(rows), 0.8)["id"].tolist()
            assert {0, 2} <= set(kept) and (1 in kept or both < 0.8 * (len(a) + len(b) - both))
            ruled_out += 1 not in kept
    assert ruled_out > 10


def test_many_bands_of_an_entry_give_one_candidate_at_first(spark, monkeypatch):
    """Bands of near copies are met by a row per entry; the links that this gives leave nothing for the other bands."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:-1], f"end{i}"])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    bands = lambda fps, *_: fps.selectExpr("id", "explode(sequence(1L, 40L)) AS key", "12L AS m")
    monkeypatch.setattr(near_copies, "neighbourhoods", bands)
    joined, possible = [], near_copies._possible
    monkeypatch.setattr(near_copies, "_possible", lambda p, *a: joined.append(p.count()) or possible(p, *a))
    assert [r.doc_id for r in near_copies.one_of_each_group(df).collect()] == [0]
    assert joined == [11]


def test_the_index_is_shuffled_packed(spark):
    """A row holds many fingerprints; all of them are there once per block, and hot nodes once per pair of parts."""
    fps = np.random.default_rng(8).integers(-(2**63), 2**63, (300, 3))
    df = spark.createDataFrame([(i - 5, x) for i, x in enumerate(fps.tolist())], "id BIGINT, fps ARRAY<BIGINT>").coalesce(1)
    value = int(np.uint64(fps[0, 1].view(np.uint64)) >> np.uint64(12)) & 0xFFF
    for hot in ({}, {(5 + 1) << 12 | value: 3}):
        rows = simhash._filed(df, 12, 2, hot).collect()
        assert len(rows) < 60
        got = {(r.slot, i, f) for r in rows for i, f in zip(simhash._words([r.id]).view(np.int64).tolist(), simhash._words([r.fp]).tolist())}
        assert got == {(5 * k + b, i - 5, int(x[k].view(np.uint64))) for i, x in enumerate(fps) for k in range(3) for b in range(5)}
        assert sum(r.part < 0 for r in rows) == (3 if hot else 0)


def test_neighbourhoods_of_much_the_same_members_are_one_band(spark, monkeypatch):
    """Entries that are not similar but share many neighbourhoods have a few rows each; who shares one still meets."""
    rng, words = np.random.default_rng(9), [f"w{i}" for i in range(90)]
    rows = [(i, changed(rng, words, range(10 * (i % 4), 10 * (i % 4) + 3 + i // 4, 2))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    bands = lambda fps, *_: fps.selectExpr("id", "explode(sequence(1L, 60L)) AS key", "20L AS m").where("pmod(xxhash64(id, key), 2) = 0")
    monkeypatch.setattr(near_copies, "neighbourhoods", bands)
    held, keep = [], near_copies._Bands.keep

    def counted(self, df, purpose):
        out = keep(self, df, purpose)
        held.append(out.count() if purpose == "bands" else 0)
        return out

    monkeypatch.setattr(near_copies._Bands, "keep", counted)
    assert sorted(r.doc_id for r in near_copies.one_of_each_group(df).collect()) == sorted(set(jaccard_groups(rows).values()))
    assert 0 < max(held) <= 80


def test_bands_keep_all_meetings(spark):
    """Two rows that share a neighbourhood share a band, of their smallest sizes."""
    fps = np.random.default_rng(10).integers(-(2**63), 2**63, (20, 4))
    fps = np.repeat(fps, 15, axis=0) ^ (np.int64(1) << np.random.default_rng(11).integers(0, 62, (300, 4)))
    data = [(1000 + i, 5 + i % 40, x) for i, x in enumerate(fps.tolist())]
    df = spark.createDataFrame(data, "id BIGINT, n BIGINT, fps ARRAY<BIGINT>")
    near = simhash.neighbourhoods(df, 300, 4, 12, 10)
    members = {}
    for r in (found := near.collect()):
        members.setdefault(r.key, []).append(r.id)
    assert all(r.least == min(members[r.key]) and r.low == min(5 + (i - 1000) % 40 for i in members[r.key]) for r in found)
    plain = simhash.neighbourhoods(df.drop("n"), 300, 4, 12, 10)
    assert {(r.id, r.key, r.m) for r in plain.collect()} == {(r.id, r.key, r.m) for r in found}
    for given in (near, plain):
        got, low = {}, {}
        for r in near_copies._joined(given).collect():
            got.setdefault(r.id, set()).add(r.key)
            low.setdefault(r.key, []).append((r.low, 5 + (r.id - 1000) % 40))
        assert all(got[a] & got[b] for ids in members.values() for a in ids for b in ids)
        assert all(least <= n for x in low.values() for least, _ in x[:1] for _, n in x) or given is near
        assert len(found) > 3 * sum(map(len, got.values()))
