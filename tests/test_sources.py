"""Trace and capture files, flow text and sketch sizes."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from packetloom.operators.basic import map_cols, tag_queries, tagged
from packetloom.plans.fixtures import packets_from_events
from packetloom.sources import config, flowtext, pcap, trace
from conftest import SF


def test_trace_round_trip_in_pieces(spark, tmp_path):
    packets = packets_from_events(spark, SF).drop("epoch")
    path = str(tmp_path / "trace")
    trace.write_trace(packets.where("pkt_no < 700"), path)
    assert not [f for f in os.listdir(path) if not f.endswith(".trace")]
    back = trace.read_trace(spark, path, partition_records=100)
    assert back.rdd.getNumPartitions() == 7
    assert back.exceptAll(packets).count() == 0 and back.count() == 700


def test_trace_numbers_run_through_files(spark, tmp_path):
    record = struct.pack(">II", 1, 2) + struct.pack("<HHBi", 3, 4, 6, 60) + struct.pack(">II", 7, 8) + struct.pack(
        "<BdBB", 18, 1.5, 20, 20
    )
    assert len(record) == 36
    (tmp_path / "a.trace").write_bytes(record * 3)
    (tmp_path / "b.trace").write_bytes(record * 2)
    rows = trace.read_trace(spark, str(tmp_path)).orderBy("pkt_no").collect()
    assert [r["pkt_no"] for r in rows] == [0, 1, 2, 3, 4]
    r = rows[4]
    assert (r["src_addr"], r["dst_addr"], r["sport"], r["dport"], r["size"]) == (1, 2, 3, 4, 60)
    assert (r["tcp_ack"], r["tcp_seq"], r["tcp_flags"], r["pkt_ts"]) == (7, 8, 18, 1.5)


def test_trace_of_broken_length_is_refused(spark, tmp_path):
    (tmp_path / "bad.trace").write_bytes(b"x" * 40)
    with pytest.raises(Exception, match="not whole 36-byte records"):
        trace.read_trace(spark, str(tmp_path)).count()


def test_trace_folder_is_replaced_or_continued(spark, tmp_path):
    packets = packets_from_events(spark, SF).drop("epoch")
    path = str(tmp_path / "trace")
    trace.write_trace(packets.where("pkt_no < 50"), path)
    trace.write_trace(packets.where("pkt_no >= 50 and pkt_no < 80"), path)
    both = trace.read_trace(spark, path).orderBy("pkt_no").collect()
    assert [r["src_addr"] for r in both] == [r["src_addr"] for r in packets.where("pkt_no < 80").orderBy("pkt_no").collect()]
    trace.write_trace(packets.where("pkt_no < 30"), path, mode="overwrite")
    assert trace.read_trace(spark, path).count() == 30
    trace.write_trace(packets.where("pkt_no < 0"), str(tmp_path / "none"))
    assert trace.read_trace(spark, str(tmp_path / "none")).count() == 0


def capture(path, order, magic, ticks, n, seed):
    rng = random.Random(seed)
    want = []
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 101))
        for i in range(n):
            size = rng.choice([0, 20, 60, 1500, 1800])
            # Zeros look like headers of empty packets and mislead a guess.
            data = bytes(rng.choice([0, 0, 0, 0, 1, 9]) for _ in range(size))
            f.write(struct.pack(order + "IIII", 1700000000 + i, 25 * ticks, size, size + 4) + data)
            want.append(((1700000000 + i) * 1000000 + 25, size, size + 4, data))
    return want


@pytest.mark.parametrize("piece_bytes", [1 << 27, 20000])
def test_captures(spark, tmp_path, piece_bytes):
    want = capture(tmp_path / "a.pcap", "<", 0xA1B2C3D4, 1, 150, 1)
    want += capture(tmp_path / "b.pcap", ">", 0xA1B23C4D, 1000, 70, 2)
    (tmp_path / "c.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101))
    df = pcap.read_pcap(spark, str(tmp_path), piece_bytes)
    rows = df.selectExpr("pkt_no", "unix_micros(ts) AS us", "caplen", "len", "data").orderBy("pkt_no").collect()
    assert [r["pkt_no"] for r in rows] == list(range(220))
    assert [(r["us"], r["caplen"], r["len"], bytes(r["data"])) for r in rows] == want


def test_captures_in_folders_and_globs(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "_hidden").mkdir()
    want = capture(tmp_path / "x" / "a.pcap", "<", 0xA1B2C3D4, 1, 20, 3)
    want += capture(tmp_path / "x" / "y" / "b.pcap", "<", 0xA1B2C3D4, 1, 10, 4)
    capture(tmp_path / "x" / "_hidden" / "c.pcap", "<", 0xA1B2C3D4, 1, 5, 5)
    capture(tmp_path / "z.cap", "<", 0xA1B2C3D4, 1, 5, 6)
    for path in (str(tmp_path / "x"), f"{tmp_path}/*/*.pcap"):
        df = pcap.read_pcap(spark, path, max_caplen=100)
        rows = df.selectExpr("unix_micros(ts) AS us", "caplen", "len", "data", "pkt_no").orderBy("pkt_no").collect()
        assert [(r["us"], r["caplen"], r["len"], bytes(r["data"])) for r in rows] == [
            (us, min(n, 100), size, data[:100]) for us, n, size, data in want
        ]


@pytest.mark.parametrize("piece_bytes", [1 << 27, 20000])
def test_damage_is_not_silent(spark, tmp_path, piece_bytes):
    capture(tmp_path / "a.pcap", "<", 0xA1B2C3D4, 1, 150, 1)
    data = bytearray((tmp_path / "a.pcap").read_bytes())
    at = 24
    for _ in range(60):
        at += 16 + struct.unpack_from("<I", data, at + 8)[0]
    struct.pack_into("<I", data, at + 8, 0x7FFFFFFF)
    (tmp_path / "a.pcap").write_bytes(data)
    with pytest.raises(Exception, match=f"a.pcap: damaged record at byte {at}"):
        pcap.read_pcap(spark, str(tmp_path), piece_bytes).count()


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"not a capture file at all")
    with pytest.raises(Exception, match="not a capture file"):
        pcap.read_pcap(spark, str(tmp_path)).count()


def test_flow_text(spark):
    line = "10.0.0.1(1234) <-> 192.168.1.2(80) 6 60"
    df = flowtext.parse_flow_text(spark.createDataFrame([(line,), ("noise",)], "value string"))
    assert [tuple(r) for r in df.collect()] == [(0x0A000001, 1234, 0xC0A80102, 80, 6, 60, None), (*[None] * 6, "noise")]
    assert flowtext.format_flow_text(df).first()[0] == line


def test_sketch_conf(spark, tmp_path):
    path = str(tmp_path / "conf")
    rows = [("distinct_table", 2, 8), ("reduce_table", 3, 2)]
    config.write_sketch_conf(spark, spark.createDataFrame(rows, "table string, d int, w int"), path)
    assert config.sketch_sizes(config.read_sketch_conf(spark, path)) == {t: (d, w) for t, d, w in rows}
    (tmp_path / "pretty.json").write_text('{\n  "t": {\n    "d": 1,\n    "w": 4\n  }\n}\n')
    assert config.sketch_sizes(config.read_sketch_conf(spark, str(tmp_path / "pretty.json"))) == {"t": (1, 4)}


def test_map_refuses_non_integers(spark):
    df = spark.range(1)
    for bad in ("x", 1.5, True, {"op": "sum", "values": ["a", "b"]}):
        with pytest.raises(ValueError):
            map_cols(df, ["id"], {"count": bad})


def test_more_queries_than_bits(spark):
    df = spark.range(200)
    wanted = {f"q{i}": F.col("id") % 100 == i for i in range(70)}
    marked = tag_queries(df, wanted)
    assert marked.count() == 140
    assert [tagged(marked, i).count() for i in (0, 61, 62, 69)] == [2] * 4
