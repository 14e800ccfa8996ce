"""Sketch operators against a packet-by-packet simulation with the same hash."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from packetloom.functions.hashing import MULTIPLIERS, OFFSETS, PRIME, explode_cells, row_pair
from packetloom.operators import aggregate, sketch


def cell(i, keys, width):
    x = OFFSETS[i]
    for k in keys:
        x = ((x + k) % PRIME * MULTIPLIERS[i] + OFFSETS[i]) % PRIME
        x = (x * x + MULTIPLIERS[i]) % PRIME
    return x % width


def rows_of(packets):
    return sorted(packets.collect(), key=lambda r: r["pkt_no"])


def test_cells(packets):
    got = {(r["pkt_no"], r["row"]): r["cell"] for r in explode_cells(packets, ["dst_addr", "src_addr"], 4, 97).collect()}
    for r in packets.collect():
        for i in range(4):
            assert got[r["pkt_no"], i] == cell(i, [r["dst_addr"], r["src_addr"]], 97)


def test_a_sketch_has_rows(packets):
    with pytest.raises(ValueError):
        explode_cells(packets, ["dst_addr"], 0, 8)
    pairs = [row_pair(i) for i in range(40)]
    assert len(set(pairs)) == 40 and all(0 < a < PRIME and 0 < b < PRIME for a, b in pairs)
    assert explode_cells(packets, ["dst_addr"], 9, 8).select("row").distinct().count() == 9


@pytest.mark.parametrize("mode", ["running", "final"])
def test_count_min_refuses_negative_steps(packets, mode):
    with pytest.raises(Exception, match="non-negative"):
        sketch.heavy_keys_cm(packets.withColumn("size", -F.col("size")), ["dst_addr"], "size", 2, 8, 5, mode).collect()


@pytest.mark.parametrize("d,width", [(1, 16), (2, 32), (3, 8)])
def test_bloom(packets, d, width):
    bits, want = set(), []
    for r in rows_of(packets):
        at = {(r["epoch"], i, cell(i, [r["dst_addr"], r["src_addr"]], width)) for i in range(d)}
        if not at <= bits:
            want.append(r["pkt_no"])
        bits |= at
    got = sketch.bloom_distinct(packets, ["dst_addr", "src_addr"], d, width)
    assert sorted(r["pkt_no"] for r in got.collect()) == want
    assert got.columns == packets.columns


@pytest.mark.parametrize("d,width,rows", [(1, 4, None), (2, 8, None), (2, 8, 30), (3, 5, 30)])
def test_count_min(packets, d, width, rows):
    table, want, last = defaultdict(int), {}, {}
    for r in rows_of(packets):
        at = [(r["epoch"], i, cell(i, [r["dst_addr"]], width)) for i in range(d)]
        for c in at:
            table[c] += r["size"]
        want[r["pkt_no"]] = min(table[c] for c in at)
    got = sketch.reduce_cm(packets, ["dst_addr"], "size", d, width, rows=rows)
    assert {r["pkt_no"]: r["estimate"] for r in got.collect()} == want
    final = sketch.reduce_cm(packets, ["dst_addr"], "size", d, width, "final").collect()
    for r in final:
        last[r["epoch"], r["dst_addr"]] = r["estimate"]
    assert last == {
        (e, k): min(table[e, i, cell(i, [k], width)] for i in range(d))
        for e, k in {(r["epoch"], r["dst_addr"]) for r in packets.collect()}
    }


@pytest.mark.parametrize("rows", [None, 20])
def test_shared_registers(packets, rows):
    d, width = 2, 6
    add, assign, want = defaultdict(int), defaultdict(int), {}
    for r in rows_of(packets):
        at = [(r["epoch"], i, cell(i, [r["dst_addr"]], width)) for i in range(d)]
        for c in at:
            add[c] += 1 if r["tcp_flags"] == 18 else -1
            if r["tcp_flags"] == 2:
                assign[c] = r["size"]
        want[r["pkt_no"]] = (min(add[c] for c in at), min(assign[c] for c in at))
    delta = F.when(F.col("tcp_flags") == 18, 1).otherwise(-1)
    got = sketch.state_shared_cells(packets, ["dst_addr"], d, width, ("add", delta), "a", rows=rows)
    got = sketch.state_shared_cells(
        got, ["dst_addr"], d, width, ("assign", F.col("tcp_flags") == 2, "size"), "b", rows=rows
    )
    assert {r["pkt_no"]: (r["a"], r["b"]) for r in got.collect()} == want


@pytest.mark.parametrize("d,width", [(1, 4), (2, 4), (3, 2)])
def test_fingerprint(packets, d, width):
    owner, want = {}, {}
    for r in rows_of(packets):
        for i in range(d):
            at = (r["epoch"], i, cell(i, [r["dst_addr"]], width))
            if owner.setdefault(at, r["dst_addr"]) == r["dst_addr"]:
                want[r["pkt_no"]] = i
                break
    got = sketch.state_fingerprint(packets, ["dst_addr"], d, width)
    assert {r["pkt_no"]: r["row"] for r in got.collect()} == want


def test_page_sizes():
    assert sketch.cells_per_row(8, 1) == 1048576
    assert sketch.cells_per_row(8, 32) == 32768


def test_stored_distinct_sketches_merge(spark):
    rows = [(e, k, v) for e in range(4) for k, size in ((1, 50), (2, 3000)) for v in range(e * size // 2, e * size // 2 + size)]
    df = spark.createDataFrame([*rows, (0, 3, None)], "epoch long, k long, v long")
    stored = aggregate.distinct_sketches(df, ["k"], ["v"])
    per_epoch = {tuple(r) for r in aggregate.merged_distinct_count(stored, ["epoch", "k"]).collect()}
    assert {r for r in per_epoch if r[1] == 1} == {(e, 1, 50) for e in range(4)} and (0, 3, 0) in per_epoch
    merged = dict(tuple(r) for r in aggregate.merged_distinct_count(stored, ["k"]).collect())
    assert merged[1] == 125 and merged[3] == 0 and abs(merged[2] - 7500) <= 0.05 * 7500
    pairs = aggregate.distinct_sketches(df.where("k = 1"), ["k"], ["epoch", "v"])
    assert aggregate.merged_distinct_count(pairs, ["k"]).first()["count"] == 200
    assert aggregate.merged_distinct_count(aggregate.distinct_sketches(df.limit(0), ["k"], ["v"]), ["k"]).collect() == []
