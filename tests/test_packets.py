"""Packet headers, text decoding and reassembly, batch and stream."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stmtgauge.functions import binary as B
from stmtgauge.operators import packets
from stmtgauge.streaming import jobs

SCHEMA = "conn_id BIGINT, seq BIGINT, bytes BINARY"


def packet(kind, end, payload, spid=7):
    return bytes([kind, end]) + (len(payload) + 8).to_bytes(2, "big") + spid.to_bytes(2, "big") + bytes([1, 0]) + payload


def test_header_and_type_names(spark):
    rows = [(1, 1, bytes.fromhex("0101000C002A0100") + b"abcd"), (1, 2, b"\x01\x01"), (1, 3, bytes.fromhex("FE01000800010100")), (1, 4, bytes.fromhex("0101000C00010100"))]
    got = {r.seq: r for r in packets.decode_packets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 3}
    one = got[1]
    assert (one.type, one.status, one.length, one.spid, one.packet, one.window, one.type_name) == (1, 1, 12, 42, 1, 0, "SQL Batch")
    assert bytes(one.payload) == b"abcd" and got[3].type_name == "Unknown(0xfe)"


def test_text_decoding_matches_the_codecs(spark):
    rng = random.Random(4)
    units = [b"a\x00", b"\x00\xd8", b"\x01\xdc", b"\xe5\x00", b"\xff\xdb", b"x"]
    texts = {b"".join(rng.choice(units) for _ in range(rng.randint(0, 7))) for _ in range(800)} | {b"abc", "SELECT 1".encode("utf-16le")}

    def strict(data):
        try:
            return data.decode("utf-16le")
        except UnicodeDecodeError:
            return data.decode("latin-1")

    df = spark.createDataFrame([(t,) for t in texts], "b BINARY")
    for r in df.select("b", B.utf16_or_latin1(F.col("b")).alias("s"), B.utf16_lenient(F.col("b")).alias("l")).collect():
        data = bytes(r.b)
        assert (r.s, r.l) == (strict(data), data.decode("utf-16le", errors="ignore")), data


def random_traffic(seed, n):
    """Interleaved messages, one connection with most packets, some never ended, odd types in between."""
    rng = random.Random(seed)
    rows, waiting, expected = [], {}, []
    for seq in range(n):
        conn = 1 if rng.random() < 0.6 else rng.randint(2, 5)
        kind = rng.choice([1, 1, 3, 18])
        payload, end = f"{seq};".encode("utf-16le"), rng.random() < 0.35 and conn != 5
        at = seq * rng.choice([1, 1, 1]) + (seq // 100) * 70000
        rows.append((conn, at, packet(kind, int(end), payload)))
        if kind == 18:
            continue
        waiting.setdefault((conn, kind), []).append(payload)
        if end:
            expected.append((conn, kind, at, b"".join(waiting.pop((conn, kind))).decode("utf-16le")))
    return rows, sorted(expected)


def test_reassembly_matches_a_plain_walk(spark):
    rows, expected = random_traffic(1, 1500)
    got = packets.reassemble_messages(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.conn_id, r.type, r.end_seq, r.text) for r in got.collect()) == expected


def test_reassembly_over_batches_matches_the_batch(spark, tmp_path):
    rows, expected = random_traffic(2, 400)
    source = tmp_path / "in"
    for i in range(4):
        part = spark.createDataFrame(rows[i * 100 : (i + 1) * 100], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    seen = []

    def sink(df, batch_id):
        seen.extend((r.conn_id, r.type, r.end_seq, r.text) for r in df.collect())

    jobs.run_incremental(stream, jobs.reassembly(str(tmp_path / "state"), sink), str(tmp_path / "check"))
    assert sorted(seen) == expected
