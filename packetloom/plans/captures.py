"""Raw capture rows and files derived from the test tables, with their SQL."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.plans.fixtures import packet_columns
from packetloom.schema import ORDER
from packetloom.sources.files import resolve
from packetloom.sources.pcap import RAW_SCHEMA


def _be(value: Column, n: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), 2 * n, "0")


def raw_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture rows of the events."""
    return as_captured(packet_columns(spark.read.parquet(f"{sf_dir}/events.parquet")))


def as_captured(p: DataFrame) -> DataFrame:
    """IP packets in bytes, one per packet; one in fifty of each kind is damaged."""
    kind = F.col("pkt_no") % 50
    proto = F.when(kind.isin(4, 9), 1).when(kind == 5, 47).otherwise(F.col("proto"))
    first = F.when(kind == 1, "65").when(kind == 2, "46").otherwise("45")
    ip = F.concat(
        first, F.lit("00"), _be(F.col("size"), 2), F.lit("0000000040"), _be(proto, 1), F.lit("0000"),
        _be(F.col("src_addr"), 4), _be(F.col("dst_addr"), 4),
    )
    tcp = F.concat(
        _be(F.col("sport"), 2), _be(F.col("dport"), 2), _be(F.col("tcp_seq"), 4), _be(F.col("tcp_ack"), 4),
        F.lit("50"), _be(F.col("tcp_flags"), 1), F.lit("000000000000"),
    )
    udp = F.concat(_be(F.col("sport"), 2), _be(F.col("dport"), 2), F.lit("00080000"))
    data = F.unhex(F.concat(ip, F.when(proto == 6, tcp).otherwise(udp)))
    cut = F.when(kind == 3, 30).when(kind.isin(7, 9), 24).when(kind == 8, 9).otherwise(40)
    caplen = F.least(cut, F.length(data))
    return p.select(
        F.lit("events").alias("file"),
        "pkt_no",
        "ts",
        caplen.cast("int").alias("caplen"),
        F.col("size").alias("len"),
        F.substring(data, F.lit(1), caplen).alias("data"),
    )


def write_captures(raw: DataFrame, path: str) -> None:
    """Write capture rows as capture files whose name order is packet order."""

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():06d}.pcap"
        system, final = resolve(name)
        system.create_dir(final.rsplit("/", 1)[0], recursive=True)
        attempt = final.rsplit("/", 1)[0] + f"/_attempt-{task.taskAttemptId()}"
        n = 0
        with system.open_output_stream(attempt) as f:
            f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101))
            for batch in batches:
                us = batch.column("ts").cast(pa.int64()).to_pylist()
                for t, size, data in zip(us, batch.column("len").to_pylist(), batch.column("data").to_pylist()):
                    f.write(struct.pack("<IIII", t // 1_000_000, t % 1_000_000, len(data), size) + data)
                n += batch.num_rows
        system.move(attempt, final)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    ordered = raw.repartitionByRange(ORDER).sortWithinPartitions(ORDER)
    ordered.select(*[c.split()[0] for c in RAW_SCHEMA.split(", ")]).mapInArrow(write, "n long").agg(F.sum("n")).first()


RAW = """
WITH events_raw AS (
  SELECT event_id AS pkt_no, epoch_us(ts) AS us, event_id % 50 AS kind, 40 + event_id % 1000 AS size,
         user_id AS src_addr, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS dst_addr,
         user_id % 1024 AS sport, CAST(floor(value) AS BIGINT) % 1024 AS dport,
         event_id % 7 AS tcp_seq, (event_id * 3) % 7 AS tcp_ack,
         CASE event_type WHEN 'click' THEN 2 WHEN 'signup' THEN 18
              WHEN 'view' THEN 16 WHEN 'purchase' THEN 17 ELSE 0 END AS tcp_flags,
         CASE WHEN event_id % 50 IN (4, 9) THEN 1 WHEN event_id % 50 = 5 THEN 47
              WHEN event_type = 'error' THEN 17 ELSE 6 END AS proto
  FROM events),
raw AS (
  SELECT *, least(CASE kind WHEN 3 THEN 30 WHEN 7 THEN 24 WHEN 9 THEN 24 WHEN 8 THEN 9 ELSE 40 END,
                  CASE proto WHEN 6 THEN 40 ELSE 28 END) AS caplen
  FROM events_raw),
judged AS (
  SELECT *, CASE WHEN kind = 8 THEN 'IP_NOT_FULL'
                 WHEN proto = 6 AND caplen < 40 THEN 'TCP_NOT_FULL'
                 WHEN proto = 17 AND (caplen < 28 OR (kind = 2 AND caplen < 32)) THEN 'UDP_NOT_FULL'
                 WHEN proto = 1 AND caplen < 28 THEN 'ICMP_NOT_FULL'
                 WHEN kind = 1 THEN 'IP_VER_FAIL'
                 WHEN kind = 2 THEN 'IP_OPTION'
                 WHEN proto IN (6, 17) THEN 'VALID' ELSE 'UNDEFINED' END AS status
  FROM raw)"""

_HEX = """upper(
    CASE kind WHEN 1 THEN '65' WHEN 2 THEN '46' ELSE '45' END || '00' || printf('%04x', size) || '0000000040'
    || printf('%02x', proto) || '0000' || printf('%08x', src_addr) || printf('%08x', dst_addr)
    || printf('%04x', sport) || printf('%04x', dport)
    || CASE WHEN proto = 6 THEN printf('%08x', tcp_seq) || printf('%08x', tcp_ack) || '50'
            || printf('%02x', tcp_flags) || '000000000000' ELSE '00080000' END)"""

RAW_SQL = RAW + f"""
SELECT pkt_no, us, CAST(caplen AS BIGINT) AS caplen, size AS len, left({_HEX}, CAST(2 * caplen AS INTEGER)) AS bytes
FROM raw"""

DECODE_SQL = RAW + """
SELECT pkt_no, status,
       CASE WHEN ok THEN src_addr ELSE -1 END AS src_addr, CASE WHEN ok THEN dst_addr ELSE -1 END AS dst_addr,
       CASE WHEN ok THEN sport ELSE -1 END AS sport, CASE WHEN ok THEN dport ELSE -1 END AS dport,
       CASE WHEN ok THEN proto ELSE -1 END AS proto, CASE WHEN ok THEN size ELSE -1 END AS size,
       CASE WHEN ok THEN tcp * tcp_seq ELSE -1 END AS tcp_seq, CASE WHEN ok THEN tcp * tcp_ack ELSE -1 END AS tcp_ack,
       CASE WHEN ok THEN tcp * tcp_flags ELSE -1 END AS tcp_flags, CASE WHEN ok THEN 20 ELSE -1 END AS ip_hdr_size,
       CASE WHEN ok THEN tcp * 20 ELSE -1 END AS tcp_hdr_size
FROM (SELECT *, status = 'VALID' AS ok, CASE WHEN proto = 6 THEN 1 ELSE 0 END AS tcp FROM judged)"""

VALID_SQL = RAW + """
SELECT pkt_no, (us - (SELECT min(us) FROM judged)) // 86400000000 AS epoch, dst_addr,
       CASE WHEN proto = 6 THEN tcp_flags ELSE 0 END AS tcp_flags
FROM judged WHERE status = 'VALID'"""

_SUMS = """count(*) AS packets, CAST(sum(caplen) AS BIGINT) AS cap_bytes, CAST(sum(size) AS BIGINT) AS act_bytes,
       arg_min(us, pkt_no) AS start_us, arg_max(us, pkt_no) AS end_us"""

SUMMARY_SQL = RAW + f"""
SELECT status, coalesce(packets, 0) AS packets, coalesce(cap_bytes, 0) AS cap_bytes,
       coalesce(act_bytes, 0) AS act_bytes, coalesce(start_us, -1) AS start_us, coalesce(end_us, -1) AS end_us,
       coalesce(end_us - start_us, -1) AS duration_us
FROM (VALUES ('VALID'), ('IP_OPTION'), ('NON_IP'), ('IP_NOT_FULL'), ('IP_VER_FAIL'), ('IP_CHKSUM_FAIL'), ('IP_FRAG'),
             ('TCP_NOT_FULL'), ('UDP_NOT_FULL'), ('ICMP_NOT_FULL'), ('UNDEFINED'), ('NON_GTP'), ('NON_GPRS'),
             ('TOTAL')) s(status)
LEFT JOIN (SELECT status, {_SUMS} FROM judged GROUP BY status
           UNION ALL SELECT 'TOTAL' AS status, {_SUMS} FROM judged) USING (status)"""

BIG_ENDIAN_SQL = RAW + """
SELECT pkt_no, CASE WHEN caplen > 9 THEN src_addr ELSE 0 END AS src_addr, size,
       CASE WHEN caplen > 9 THEN proto ELSE 0 END AS proto FROM raw"""

CHECKSUM_SQL = RAW + """
SELECT pkt_no, 65535 - ((s & 65535) + (s >> 16)) AS checksum FROM (
  SELECT pkt_no, CASE kind WHEN 1 THEN 25856 WHEN 2 THEN 17920 ELSE 17664 END + size
    + CASE WHEN caplen > 9 THEN 16384 + proto + src_addr + dst_addr ELSE 64 END AS s
  FROM raw)"""
