"""Packets that Spark derives from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.operators.epochs import with_epoch
from packetloom.schema import PACKET_SCHEMA

DAY_SECONDS = 86400.0


def packets_from_events(spark: SparkSession, sf_dir: str, interval: float = DAY_SECONDS) -> DataFrame:
    """One packet per event, in event order, with an epoch per day."""
    packets = packet_columns(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return with_epoch(packets, interval)


# How an event reads as a packet, by packet column.
EVENT_AS_PACKET = {
    "pkt_no": "event_id",
    "ts": "CAST(ts AS TIMESTAMP)",
    "pkt_ts": "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D",
    "src_addr": "user_id",
    "dst_addr": r"regexp_extract(props, r'(\d+)', 1)",
    "sport": "user_id % 1024",
    "dport": "floor(value) % 1024",
    "proto": "CASE WHEN event_type = 'error' THEN 17 ELSE 6 END",
    "size": "40 + event_id % 1000",
    "tcp_seq": "event_id % 7",
    "tcp_ack": "(event_id * 3) % 7",
    "tcp_flags": "CASE event_type WHEN 'click' THEN 2 WHEN 'signup' THEN 18 WHEN 'view' THEN 16"
    " WHEN 'purchase' THEN 17 ELSE 0 END",
    "ip_hdr_size": "20",
    "tcp_hdr_size": "CASE WHEN event_type = 'error' THEN 0 ELSE 20 END",
}


def packet_columns(events: DataFrame) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in PACKET_SCHEMA.fields}
    return events.selectExpr(*[f"CAST({e} AS {types[n]}) AS {n}" for n, e in EVENT_AS_PACKET.items()])


def flows_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger unordered packet set: supplier to part, one epoch per shipping year."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        F.year("l_shipdate").cast("long").alias("epoch"),
        F.col("l_suppkey").cast("long").alias("src_addr"),
        F.col("l_partkey").cast("long").alias("dst_addr"),
        F.col("l_quantity").cast("long").alias("size"),
        F.col("l_returnflag").alias("flag"),
    )


def packet_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The packets of the events as a stream, and the time of the first in microseconds."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    start_us = events.select(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return packet_columns(stream), start_us
