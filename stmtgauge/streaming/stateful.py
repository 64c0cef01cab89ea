"""Streaming steps that depend on earlier rows, with their state in Spark's own state store.

Micro-batches must arrive in order of ``seq``; inside a batch rows may come in any order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stmtgauge.operators import correct, packets

#: Parts into which the hits of one rule are dealt, and bits of ``seq`` below the block that is dealt as a whole.
SALTS, BLOCK_BITS = 8, 16


def _deal(batches: Iterator[pd.DataFrame], salts: int, bits: int) -> Iterator[pd.DataFrame]:
    """Hits with the part their block belongs to; then, for every part, how many hits each block of this task holds."""
    counts: dict[tuple[str, int], int] = defaultdict(int)
    for hits in batches:
        block = hits["seq"].to_numpy(np.int64) >> bits
        for (rule, b), n in hits.groupby(["rule_id", block]).size().items():
            counts[rule, int(b)] += int(n)
        yield hits.assign(block=block, salt=(block % salts).astype(np.int32), n=np.int64(0))
    if counts:
        rules, blocks = zip(*counts)
        sums = pd.DataFrame({"rule_id": rules, "block": blocks, "n": list(counts.values())})
        sums = sums.assign(min_hits=np.int64(0), seq=np.int64(0), step=np.int32(0), row=np.int32(0), pos=np.int32(0), is_block=False)
        for salt in range(salts):
            yield sums.assign(salt=np.int32(salt))


def _gated(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Block decisions of one part of a rule: hits of earlier batches, of earlier blocks, and up to the row itself."""
    before = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches), ignore_index=True)
    sums = rows.loc[rows["n"] > 0].groupby("block")["n"].sum().sort_index()
    earlier = sums.cumsum() - sums
    own = rows.loc[rows["n"] == 0].sort_values(["seq", "step", "row", "pos"])
    hits = before + own["block"].map(earlier) + own.groupby("block").cumcount() + 1
    own = own.assign(rule_id=key[0], hits=hits.astype(np.int64))
    own["enforced"] = own["hits"] >= own["min_hits"]
    state.update((before + int(sums.sum()),))
    yield own.loc[own["is_block"], ["seq", "rule_id", "hits", "min_hits", "enforced"]]


def stream_gates(log: DataFrame, rules: DataFrame, salts: int = SALTS, bits: int = BLOCK_BITS) -> DataFrame:
    """Gates of the block decisions of an arriving log, as :func:`~stmtgauge.operators.correct.apply_thresholds` gives them.

    State: one count per rule and part. Hits are dealt by (rule, part of its blocks of ``seq``), so a rule with a third of
    all hits is ``salts`` tasks; what each part must know of the others are sums per block, made in the tasks that read
    the hits. ``bits`` should make blocks of some hundred hits or more.
    """
    free, counted = correct.split_hits(log, rules)
    schema = "rule_id string, min_hits bigint, seq bigint, step int, row int, pos int, is_block boolean"
    narrow = counted.select(
        "rule_id", F.col("min_hits").cast("bigint"), "seq", *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("step", "row", "pos")],
        "is_block",
    )
    dealt = narrow.mapInPandas(lambda b: _deal(b, salts, bits), f"{schema}, block bigint, salt int, n bigint")
    gated = dealt.groupBy("rule_id", "salt").applyInPandasWithState(
        _gated, "seq bigint, rule_id string, hits bigint, min_hits bigint, enforced boolean", "n bigint", "append", GroupStateTimeout.NoTimeout
    )
    return free.unionByName(gated)


def _joined(patience_ms: int | None):
    """Messages of one connection and type that end in a batch; other parts wait, for ``patience_ms`` at most."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True)
        latest = rows["ts"].max()
        if state.exists:
            seq, spid, payload = state.get[:3]
            held = pd.DataFrame({"seq": seq, "spid": spid, "payload": payload, "eom": 0})
            rows = pd.concat([held, rows], ignore_index=True)
        rows = rows.sort_values("seq", kind="stable", ignore_index=True)
        last = np.flatnonzero(rows["eom"].to_numpy() != 0)
        ends, payload = (last + 1).tolist(), rows["payload"].tolist()
        whole = [b"".join(payload[start:end]) for start, end in zip([0, *ends], ends)]
        rest = rows.iloc[ends[-1] if ends else 0 :]
        if len(rest):
            state.update((rest["seq"].tolist(), rest["spid"].tolist(), rest["payload"].tolist()))
            if patience_ms is not None:
                state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs()) + patience_ms)
        elif state.exists:
            state.remove()
        if ends:
            found = rows.iloc[last]
            out = {"end_seq": found["seq"].to_numpy(), "spid": found["spid"].to_numpy(), "payload": whole}
            yield pd.DataFrame({"conn_id": key[0], "type": key[1], **out})

    return run


def stream_messages(arriving: DataFrame, ts: str | None = None, lateness: str = "1 minute", patience_s: int = 3600) -> DataFrame:
    """Messages of arriving packets, as :func:`~stmtgauge.operators.packets.reassemble_messages` gives them.

    State: the parts of each connection and type since its last end of a message. With an event time ``ts`` parts wait for
    ``patience_s`` after the newest of them and then go, so that connections which break off leave nothing behind. A
    connection is one ordered stream of bytes and therefore one task; the trigger bounds what a batch holds of it.
    """
    if ts is not None:
        arriving = arriving.withWatermark(ts, lateness)
    parts = packets.message_parts(arriving, *([ts] if ts else []))
    clock = F.col(ts) if ts else F.lit(None).cast("timestamp")
    parts = parts.select(*[c for c in parts.columns if c != ts], clock.alias("ts"))
    kind = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    found = parts.groupBy("conn_id", "type").applyInPandasWithState(
        _joined(1000 * patience_s if ts else None),
        "conn_id bigint, type int, end_seq bigint, spid int, payload binary",
        "seq array<bigint>, spid array<int>, payload array<binary>",
        "append",
        kind,
    )
    return packets.with_text(found)
