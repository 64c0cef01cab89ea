"""Packet tables: header fields and reassembly of messages. One row of ``bytes`` is one packet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtgauge.functions import binary as B
from stmtgauge.operators.running import running_total

# Types whose payload is gathered up to the end-of-message bit.
SQL_BATCH, RPC = 0x01, 0x03


def decode_packets(packets: DataFrame) -> DataFrame:
    """Add header fields, ``type_name`` and ``payload``; rows that hold no whole packet are dropped."""
    parsed = packets.withColumn("__h", B.header(F.col("bytes")))
    length = F.col("__h.length")
    whole = parsed.where(length.between(B.HEADER_BYTES, F.octet_length("bytes")))
    return whole.select(
        *packets.columns,
        "__h.*",
        B.type_name(F.col("__h.type")).alias("type_name"),
        F.substring("bytes", F.lit(B.HEADER_BYTES + 1), length - B.HEADER_BYTES).alias("payload"),
    ).drop("bytes")


PART_SCHEMA = "conn_id BIGINT, type INT, seq BIGINT, spid INT, payload BINARY, eom INT"


def message_parts(packets: DataFrame, *passed: str) -> DataFrame:
    """Batch and call packets, with their end-of-message bit (``PART_SCHEMA``) and the ``passed`` columns."""
    eom = F.col("status").bitwiseAND(B.END_OF_MESSAGE)
    return (
        decode_packets(packets)
        .where(F.col("type").isin(SQL_BATCH, RPC))
        .select("conn_id", "type", "seq", "spid", "payload", eom.alias("eom"), *passed)
    )


def number_parts(parts: DataFrame) -> DataFrame:
    """Add ``message`` (how many messages of the same connection and type ended before) and ``complete`` (the message has
    an end)."""
    numbered = running_total(parts, ["conn_id", "type"], "seq", [], F.col("eom"), "__ends", total="__all")
    message = F.col("__ends") - F.col("eom")
    return numbered.select(*parts.columns, message.alias("message"), (message < F.col("__all")).alias("complete"))


def join_parts(numbered: DataFrame) -> DataFrame:
    """(conn_id, type, end_seq, spid, payload, text) of every complete message.

    Groups hold one message each; parts of a message without an end are left out before grouping.
    """
    messages = numbered.where("complete").groupBy("conn_id", "type", "message").agg(
        F.max("seq").alias("end_seq"),
        F.max_by("spid", "seq").alias("spid"),
        F.expr("listagg(payload, X'') within group (order by seq)").alias("payload"),
    )
    return with_text(messages)


def with_text(messages: DataFrame) -> DataFrame:
    """Add ``text``, what the payload of a message says."""
    text = F.when(F.col("type") == SQL_BATCH, B.utf16_or_latin1(F.col("payload"))).otherwise(
        B.utf16_lenient(F.col("payload"))
    )
    return messages.select("conn_id", "type", "end_seq", "spid", "payload", text.alias("text"))


def reassemble_messages(packets: DataFrame) -> DataFrame:
    """Messages of a packet table; see :func:`join_parts`."""
    return join_parts(number_parts(message_parts(packets)))
