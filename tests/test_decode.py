"""Packet decoding on bytes built here, one for every status and link type."""

import struct
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from packetloom.functions import scalar
from packetloom.sources import decode

RAW = "file string, pkt_no long, ts timestamp, caplen int, len int, data binary"


def ip(proto, payload, version=4, ihl=5, checksum=0):
    head = struct.pack(
        ">BBHHHBBHII", version << 4 | ihl, 0, 20 + len(payload), 7, 0, 64, proto, checksum, 0x0A000001, 0xC0A80102
    )
    return head + b"\0" * (4 * max(ihl - 5, 0)) + payload


TCP = struct.pack(">HHIIBBHHH", 1234, 80, 4000000000, 3000000000, 5 << 4, 18, 512, 0, 0)
UDP = struct.pack(">HHHH", 53, 5353, 8, 0)
ICMP = struct.pack(">BBHI", 8, 0, 0, 0)


def decoded(spark, frames, link_len=0, **options):
    ts = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("f", i, ts, len(f), len(f) + 5, bytearray(f)) for i, f in enumerate(frames)]
    df = decode.decode_packets(spark.createDataFrame(rows, RAW), link_len, **options)
    return sorted(df.collect(), key=lambda r: r["pkt_no"])


def test_statuses(spark):
    cases = [
        (ip(6, TCP), "VALID"),
        (ip(17, UDP), "VALID"),
        (ip(1, ICMP), "UNDEFINED"),
        (ip(47, b"\0" * 8), "UNDEFINED"),
        (ip(6, TCP, version=6), "IP_VER_FAIL"),
        (ip(6, TCP, ihl=6), "IP_OPTION"),
        (ip(6, TCP, version=5, ihl=6), "IP_VER_FAIL"),
        (ip(6, TCP)[:39], "TCP_NOT_FULL"),
        (ip(6, TCP)[:25], "TCP_NOT_FULL"),
        (ip(17, UDP)[:27], "UDP_NOT_FULL"),
        (ip(1, ICMP)[:27], "ICMP_NOT_FULL"),
        (ip(6, TCP)[:9], "IP_NOT_FULL"),
        (ip(6, TCP, version=6)[:30], "TCP_NOT_FULL"),
        (b"", "IP_VER_FAIL"),
    ]
    got = decoded(spark, [c for c, _ in cases])
    assert [r["status"] for r in got] == [s for _, s in cases]
    assert all(r["src_addr"] is None for r in got if r["status"] != "VALID")


def test_fields(spark):
    tcp, udp = decoded(spark, [ip(6, TCP), ip(17, UDP)])
    assert (tcp["src_addr"], tcp["dst_addr"]) == (0x0A000001, 0xC0A80102)
    assert (tcp["sport"], tcp["dport"], tcp["proto"], tcp["size"]) == (1234, 80, 6, 40)
    assert (tcp["tcp_seq"], tcp["tcp_ack"], tcp["tcp_flags"]) == (4000000000, 3000000000, 18)
    assert (tcp["ip_hdr_size"], tcp["tcp_hdr_size"]) == (20, 20)
    assert (udp["sport"], udp["dport"], udp["tcp_seq"], udp["tcp_flags"], udp["tcp_hdr_size"]) == (53, 5353, 0, 0, 0)


@pytest.mark.parametrize(
    "link_len,head,status",
    [
        (14, b"\0" * 12 + b"\x08\x00", "VALID"),
        (14, b"\0" * 12 + b"\x81\x00" + b"\0\0\x08\x00", "VALID"),
        (14, b"\0" * 12 + b"\x86\xdd", "NON_IP"),
        (4, b"\0\0\x08\x00", "VALID"),
        (4, b"\0\0\x86\xdd", "NON_IP"),
        (8, b"\0" * 8, "NON_IP"),
    ],
)
def test_link_types(spark, link_len, head, status):
    [row] = decoded(spark, [head + ip(6, TCP)], link_len)
    assert row["status"] == status
    if status == "VALID":
        assert row["dport"] == 80


def test_checksum(spark):
    frame = ip(6, TCP)
    total = sum(struct.unpack(">10H", frame[:20]))
    total = (total & 0xFFFF) + (total >> 16)
    good = ip(6, TCP, checksum=0xFFFF - total)
    assert [r["status"] for r in decoded(spark, [frame, good], check_ip=True)] == ["IP_CHKSUM_FAIL", "VALID"]
    df = spark.createDataFrame([(bytearray(good),)], "data binary")
    assert df.select(scalar.ip_checksum("data", 0, 20)).first()[0] == 0


def test_summary_counts_every_status(spark):
    ts = datetime(2024, 1, 1, tzinfo=timezone.utc)
    frames = [ip(6, TCP), ip(6, TCP), ip(1, ICMP)]
    rows = [("f", i, ts, len(f), len(f) + 5, bytearray(f)) for i, f in enumerate(frames)]
    df = decode.decode_packets(spark.createDataFrame(rows, RAW))
    got = {r["status"]: r for r in decode.capture_summary(df).collect()}
    assert set(got) == {*decode.STATUSES, "TOTAL"}
    assert (got["VALID"]["packets"], got["VALID"]["cap_bytes"], got["VALID"]["act_bytes"]) == (2, 80, 90)
    assert got["TOTAL"]["packets"] == 3 and got["IP_FRAG"]["packets"] == 0


def test_skewed_timestamps(spark):
    df = spark.range(100).selectExpr(
        "id AS pkt_no", "timestamp_micros(CASE WHEN id % 10 = 0 THEN id * 1000 - 5000 ELSE id * 1000 END) AS ts"
    )
    late = decode.skewed_timestamps(df, rows=7).collect()
    assert sorted(r["pkt_no"] for r in late) == list(range(10, 100, 10))
