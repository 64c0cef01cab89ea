"""The registered streams: batches follow the turns, not the number of events, and many tasks write and read each."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import catalog, roundtrips, streams
from stmtgauge.streaming import stateful


@pytest.fixture
def folder(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).cast("timestamp_ntz").alias("ts")
    rows = spark.range(2000).select(
        F.col("id").alias("event_id"), at, (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type"),
        F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"),
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_a_batch_is_one_turn_in_several_files(spark, folder, monkeypatch, tmp_path):
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    seen = {}

    def keep(batch, batch_id):
        seen[batch_id] = batch.agg(F.count_distinct("file"), F.min("event_id"), F.max("event_id"), F.count("*")).first()

    stream = streams.event_stream(spark, folder).select("event_id", F.col("_metadata.file_path").alias("file"))
    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == list(range(streams.BATCHES)) and {s[0] for s in seen.values()} == {4}
    assert sum(s[3] for s in seen.values()) == 2000
    assert all(seen[i][2] < seen[i + 1][1] for i in range(streams.BATCHES - 1))


def test_fewer_rows_than_files(spark, tmp_path):
    path = str(tmp_path / "files")
    for n in (1, 0, 9):
        streams.append_files(spark.range(n), path, "parquet", 3)
    read = spark.read.schema("id BIGINT").parquet(path)
    assert len(read.inputFiles()) == 9 and read.count() == 10


def test_session_files_read_again_take_as_many_batches_as_turns(spark, folder, monkeypatch):
    monkeypatch.setattr(roundtrips, "_XML_ROWS", 20)
    begun = []
    whole = roundtrips.events.sink_query_events
    monkeypatch.setattr(roundtrips.events, "sink_query_events", lambda *a: begun.append(whole(*a)))
    read = catalog.QUERIES["source_xml_read_again"](spark, folder)
    assert sorted(r.duration_ms for r in read.collect()) == list(range(2000))
    assert begun[0].lastProgress["batchId"] <= streams.BATCHES + 1


def test_messages_of_a_busy_connection_are_cut_without_looking_rows_up():
    class State:
        exists = hasTimedOut = False

        def update(self, held):
            self.held = held

    n, state = 100_000, State()
    rows = pd.DataFrame({"seq": np.arange(n), "spid": 7, "payload": [b"%d;" % i for i in range(n)], "eom": np.arange(n) % 2, "ts": pd.NaT})
    rows = pd.concat([rows, rows.tail(1).assign(seq=n, eom=0)]).sample(frac=1, random_state=1)
    begun = time.process_time()
    (found,) = stateful._joined(None)((0, 1), iter([rows]), state)
    assert time.process_time() - begun < 2
    assert found["end_seq"].tolist() == list(range(1, n, 2)) and found["payload"].iloc[1] == b"2;3;"
    assert state.held == ([n], [7], [b"99999;"])
