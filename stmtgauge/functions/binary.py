"""Column expressions for packet bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the packet types and the end-of-message bit.
PACKET_TYPES = {
    0x01: "SQL Batch",
    0x02: "Pre-TDS Login",
    0x03: "RPC",
    0x04: "Tabular Result",
    0x12: "Login7",
    0x07: "Attention",
    0x0E: "Transaction Manager",
}
END_OF_MESSAGE = 0x01
HEADER_BYTES = 8


def unsigned(data: Column, start: int, length: int) -> Column:
    """Big-endian unsigned number from ``length`` bytes at ``start`` (from 1)."""
    return F.conv(F.hex(F.substring(data, start, length)), 16, 10).cast("int")


def header(data: Column) -> Column:
    """Header fields, NULL for fewer than eight bytes."""
    fields = F.struct(
        unsigned(data, 1, 1).alias("type"),
        unsigned(data, 2, 1).alias("status"),
        unsigned(data, 3, 2).alias("length"),
        unsigned(data, 5, 2).alias("spid"),
        unsigned(data, 7, 1).alias("packet"),
        unsigned(data, 8, 1).alias("window"),
    )
    return F.when(F.octet_length(data) >= HEADER_BYTES, fields)


def type_name(packet_type: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PACKET_TYPES.items() for x in pair])
    unknown = F.concat(F.lit("Unknown(0x"), F.lower(F.lpad(F.hex(packet_type), 2, "0")), F.lit(")"))
    return F.coalesce(F.try_element_at(names, packet_type), unknown)


def _unit_texts(data: Column) -> Column:
    """UTF-16LE code units as four hex digits each, low byte first; an odd last byte is left out."""
    return F.regexp_extract_all(F.hex(data), F.lit("[0-9A-F]{4}"), F.lit(0))


def _paired_units(units: Column) -> Column:
    """Without surrogates that lack their partner."""
    high = lambda u: F.substring(u, 3, 2).between("D8", "DB")
    low = lambda u: F.substring(u, 3, 2).between("DC", "DF")

    def keep(unit: Column, i: Column) -> Column:
        after, before = F.get(units, i + 1), F.get(units, i - 1)
        return (
            F.when(high(unit), F.coalesce(low(after), F.lit(False)))
            .when(low(unit), F.coalesce(high(before), F.lit(False)))
            .otherwise(F.lit(True))
        )

    return F.filter(units, keep)


def _may_hold_surrogates(data: Column) -> Column:
    return F.hex(data).rlike("D[89A-F]")


def utf16_lenient(data: Column) -> Column:
    """Decode UTF-16LE; malformed units are left out."""
    even = F.substring(data, F.lit(1), (F.octet_length(data) - F.octet_length(data) % 2).cast("int"))
    kept = F.unhex(F.array_join(_paired_units(_unit_texts(data)), ""))
    return F.decode(F.when(_may_hold_surrogates(data), kept).otherwise(even), "UTF-16LE")


def utf16_or_latin1(data: Column) -> Column:
    """Decode UTF-16LE when well-formed, else ISO-8859-1."""
    units = _unit_texts(data)
    broken = F.when(_may_hold_surrogates(data), F.size(_paired_units(units)) < F.size(units)).otherwise(F.lit(False))
    odd = F.octet_length(data) % 2 == 1
    return F.when(odd | broken, F.decode(data, "ISO-8859-1")).otherwise(F.decode(data, "UTF-16LE"))
