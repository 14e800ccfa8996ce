"""The packet table: its schema, named constants and field names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F, types as T

EPOCH = "epoch"
ORDER = "pkt_no"

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("pkt_no", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("pkt_ts", T.DoubleType()),
        T.StructField("src_addr", T.LongType()),
        T.StructField("dst_addr", T.LongType()),
        T.StructField("sport", T.IntegerType()),
        T.StructField("dport", T.IntegerType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("tcp_seq", T.LongType()),
        T.StructField("tcp_ack", T.LongType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("ip_hdr_size", T.IntegerType()),
        T.StructField("tcp_hdr_size", T.IntegerType()),
    ]
)

# IP protocol numbers and TCP flag bits (public standards).
CONSTANTS = {
    "IP_PROTOCOLS_ICMP": 1,
    "IP_PROTOCOLS_TCP": 6,
    "IP_PROTOCOLS_UDP": 17,
    "TCP_FLAG_FIN": 1,
    "TCP_FLAG_SYN": 2,
    "TCP_FLAG_RST": 4,
    "TCP_FLAG_PUSH": 8,
    "TCP_FLAG_ACK": 16,
    "TCP_FLAG_SYN_ACK": 18,
}

# The query-language field names and the columns they stand for.
FIELD_ALIASES = {
    "ipv4.src_addr": "src_addr",
    "ipv4.dst_addr": "dst_addr",
    "ipv4.protocol": "proto",
    "tcp.sport": "sport",
    "tcp.src_port": "sport",
    "tcp.dport": "dport",
    "tcp.dst_port": "dport",
    "tcp.seq": "tcp_seq",
    "tcp.ack": "tcp_ack",
    "tcp.flags": "tcp_flags",
    "tcp.flag": "tcp_flags",
}

Operand = Column | str | int


def column_name(field: str) -> str:
    """Column behind a field name; derived variables keep their own name."""
    return FIELD_ALIASES.get(field, field)


def column_names(fields: str | Iterable[str]) -> list[str]:
    if isinstance(fields, str):
        fields = [fields]
    return [column_name(f) for f in fields]


def operand(value: Operand) -> Column:
    """Column for a field, derived variable, integer or named constant."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        if value in CONSTANTS:
            return F.lit(CONSTANTS[value])
        if value == "tcp.timestamp":
            return (F.col("pkt_ts") * F.lit(1e9)).cast("long")
        return F.col(column_name(value))
    return F.lit(value)
