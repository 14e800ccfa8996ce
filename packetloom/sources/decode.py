"""From captured bytes to typed packets, with a status for every one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.functions.scalar import big_endian, ip_checksum
from packetloom.operators.running import SEGMENT_ROWS, previous, running_over_all
from packetloom.schema import CONSTANTS, ORDER

# Every status a packet can be reported under.
STATUSES = (
    "VALID",
    "IP_OPTION",
    "NON_IP",
    "IP_NOT_FULL",
    "IP_VER_FAIL",
    "IP_CHKSUM_FAIL",
    "IP_FRAG",
    "TCP_NOT_FULL",
    "UDP_NOT_FULL",
    "ICMP_NOT_FULL",
    "UNDEFINED",
    "NON_GTP",
    "NON_GPRS",
)

# Ethertypes.
ETHERTYPE_IP = 0x0800
ETHERTYPE_VLAN = 0x8100

_TCP = CONSTANTS["IP_PROTOCOLS_TCP"]
_UDP = CONSTANTS["IP_PROTOCOLS_UDP"]
_ICMP = CONSTANTS["IP_PROTOCOLS_ICMP"]


def _link(link_len: int) -> tuple[Column, Column]:
    """Bytes before the IP header, and whether the link header says it is not IP."""
    if link_len == 14:
        ethertype = big_endian("data", 12, 2)
        vlan = ethertype == ETHERTYPE_VLAN
        return F.when(vlan, 18).otherwise(14), ~vlan & (ethertype != ETHERTYPE_IP)
    if link_len == 4:
        return F.lit(4), big_endian("data", 2, 2) != ETHERTYPE_IP
    return F.lit(link_len), F.lit(link_len != 0)


def decode_packets(df: DataFrame, link_len: int = 0, check_ip: bool = False) -> DataFrame:
    """Decode IP, TCP and UDP headers of (…, pkt_no, ts, caplen, len, data) rows.

    Adds ``status`` and the packet columns; these are null unless the status is
    ``VALID``. A later check overrides an earlier one. Good ICMP packets and
    packets of other protocols stay ``UNDEFINED``.
    """
    ip_at, non_ip = _link(link_len)
    kept = [c for c in df.columns if c not in ("data",)]
    heads = df.select("*", ip_at.cast("int").alias("_ip"), non_ip.alias("_non_ip"))
    parsed = F.struct(
        big_endian("data", F.col("_ip"), 1).alias("_first"),
        big_endian("data", F.col("_ip") + 9, 1).cast("int").alias("_proto"),
    )
    # A one-element inline keeps a filter on the status from being pushed below
    # the parsing, which would repeat it inside every branch of the condition.
    heads = heads.select("*", F.inline(F.array(parsed)))
    heads = heads.select(
        "*",
        (F.col("caplen") - F.col("_ip")).alias("_len"),
        F.shiftright("_first", 4).alias("_version"),
        (F.col("_first").bitwiseAND(15) * 4).cast("int").alias("_ihl"),
    )
    heads = heads.withColumn("_l4", F.col("_ip") + F.col("_ihl"))
    heads = heads.withColumn(
        "_tcp_len",
        (F.shiftright(big_endian("data", F.col("_l4") + 12, 1), 4) * 4).cast("int"),
    )
    length, ihl, proto = F.col("_len"), F.col("_ihl"), F.col("_proto")
    transport_full = (
        # The header length itself has to be captured as well.
        F.when(proto == _TCP, (length >= ihl + F.col("_tcp_len")) & (length > ihl + 12))
        .when(proto.isin(_UDP, _ICMP), length >= ihl + 8)
        .otherwise(True)
    )
    network = F.when(F.col("_version") != 4, "IP_VER_FAIL").when(ihl != 20, "IP_OPTION")
    if check_ip:
        bad = ip_checksum("data", F.col("_ip"), ihl) != 0
        network = F.when(bad, "IP_CHKSUM_FAIL").when(F.col("_version") != 4, "IP_VER_FAIL").when(
            ihl != 20, "IP_OPTION"
        )
    network = network.when(length < ihl, "IP_NOT_FULL").when(F.col("_non_ip"), "NON_IP")
    status = (
        F.when(~transport_full & (proto == _TCP), "TCP_NOT_FULL")
        .when(~transport_full & (proto == _UDP), "UDP_NOT_FULL")
        .when(~transport_full & (proto == _ICMP), "ICMP_NOT_FULL")
        .otherwise(
            F.coalesce(network, F.when(proto.isin(_TCP, _UDP), "VALID").otherwise("UNDEFINED"))
        )
    )
    heads = heads.withColumn("status", status)
    valid, tcp, l4 = F.col("status") == "VALID", proto == _TCP, F.col("_l4")

    def field(value: Column, kind: str) -> Column:
        return F.when(valid, value.cast(kind)).cast(kind)

    def tcp_field(value: Column, kind: str) -> Column:
        return field(F.when(tcp, value).otherwise(0), kind)

    ip = F.col("_ip")
    return heads.select(
        *kept,
        "status",
        field(F.unix_micros("ts") / F.lit(1e6), "double").alias("pkt_ts"),
        field(big_endian("data", ip + 12, 4), "long").alias("src_addr"),
        field(big_endian("data", ip + 16, 4), "long").alias("dst_addr"),
        field(big_endian("data", l4, 2), "int").alias("sport"),
        field(big_endian("data", l4 + 2, 2), "int").alias("dport"),
        field(proto, "int").alias("proto"),
        field(big_endian("data", ip + 2, 2), "int").alias("size"),
        tcp_field(big_endian("data", l4 + 4, 4), "long").alias("tcp_seq"),
        tcp_field(big_endian("data", l4 + 8, 4), "long").alias("tcp_ack"),
        tcp_field(big_endian("data", l4 + 13, 1), "int").alias("tcp_flags"),
        field(ihl, "int").alias("ip_hdr_size"),
        tcp_field(F.col("_tcp_len"), "int").alias("tcp_hdr_size"),
    )


def write_valid(
    df: DataFrame, path: str, partition_by: str | None = "epoch", order: str = ORDER, mode: str = "error"
) -> None:
    """Persist the valid packets, by epoch when they have one.

    Ranges of (epoch, packet number) keep a task to few folders and split a
    crowded epoch over many tasks.
    """
    valid = df.where(F.col("status") == "VALID").drop("status", "file", "caplen", "len")
    if partition_by and partition_by in valid.columns:
        placed = valid.repartitionByRange(partition_by, order)
        placed.write.mode(mode).partitionBy(partition_by).parquet(path)
    else:
        valid.write.mode(mode).parquet(path)


def write_valid_stream(
    df: DataFrame, path: str, progress: str, partition_by: str | None = "epoch", available_now: bool = False
) -> StreamingQuery:
    """Streaming form of ``write_valid``: appends the valid packets of each micro-batch.

    ``progress`` is the shared folder that makes the sink exactly-once after a restart.
    """
    valid = df.where(F.col("status") == "VALID").drop("status", "file", "caplen", "len")
    writer = valid.writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress)
    if partition_by and partition_by in valid.columns:
        writer = writer.partitionBy(partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def status_counts(df: DataFrame, order: str = ORDER) -> DataFrame:
    """Packets, bytes and time span per status; also for a stream in complete mode."""
    ts = F.unix_micros("ts")
    return df.groupBy("status").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("caplen").cast("long").alias("cap_bytes"),
        F.sum("len").cast("long").alias("act_bytes"),
        F.min(order).alias("_first"),
        F.max(order).alias("_last"),
        F.min_by(ts, F.col(order)).alias("start_us"),
        F.max_by(ts, F.col(order)).alias("end_us"),
    )


def capture_summary(df: DataFrame, order: str = ORDER) -> DataFrame:
    """Packets, captured and actual bytes and trace span, per status and in all (``TOTAL``).

    Statuses that did not occur have a row of zeros. The trace starts and ends
    with its first and last packet, not with its extreme timestamps.
    """
    return summary_of_counts(status_counts(df, order))


def summary_of_counts(per_status: DataFrame) -> DataFrame:
    """The summary of the at most thirteen rows of :func:`status_counts`."""
    counted = (
        per_status.rollup("status")
        .agg(
            *[F.sum(c).alias(c) for c in ("packets", "cap_bytes", "act_bytes")],
            F.min_by("start_us", "_first").alias("start_us"),
            F.max_by("end_us", "_last").alias("end_us"),
        )
        .withColumn("status", F.coalesce("status", F.lit("TOTAL")))
    )
    names = F.array(*[F.lit(s) for s in (*STATUSES, "TOTAL")])
    every = per_status.sparkSession.range(1).select(F.explode(names).alias("status"))
    return (
        every.join(counted, "status", "left")
        .na.fill(0, ["packets", "cap_bytes", "act_bytes"])
        .withColumn("duration_us", F.col("end_us") - F.col("start_us"))
    )


def skewed_timestamps(df: DataFrame, order: str = ORDER, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Packets stamped earlier than the packet before them, with ``previous_us``."""
    ts = F.unix_micros("ts")
    seen = running_over_all(df, {"previous_us": previous(ts, order)}, order, rows)
    return seen.where(ts < F.col("previous_us"))
