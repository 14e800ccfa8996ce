"""Folds over many keys at once: equal to a call per key, in any cut, with nulls."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from conftest import scratch
from packetloom.operators import state
from packetloom.operators.folds import GroupedFold, KeyedFold, without_nulls
from packetloom.plans import detections
from packetloom.streaming import detections as S, windows
from packetloom.streaming.state import stateful_fold_stream

FLOWS = "epoch long, pkt_no long, src_addr long, dst_addr long, sport long, dport long, tcp_seq long"
BIG = (1 << 60) + 1


def flow_rows(seed=5, n=400):
    rng = random.Random(seed)
    hot = [(0, no, 1, 2, 3, 4, rng.randrange(9)) for no in range(n, n + 60)]
    return hot + [(rng.choice([0, 1, None]), no, rng.choice([1, 2, None]), rng.choice([BIG, BIG + 2]), 3, rng.choice([4, None]), rng.randrange(9)) for no in range(n)]


def late_by_hand(rows):
    largest, late = {}, {}
    for epoch, no, *key, seq in sorted(rows, key=lambda r: r[1]):
        key = (epoch, *key)
        late[key] = late.get(key, 0) + (seq <= largest.get(key, 0))
        largest[key] = max(largest.get(key, 0), seq)
    return {(*k, n) for k, n in late.items()}


@pytest.mark.parametrize("rows", [2, 7, 1000])
def test_small_calls_take_no_waves(spark, monkeypatch, rows):
    """Waves follow the packets a task can hold, not the size of a call."""
    waves, write = [], state._write_waves
    monkeypatch.setattr(state, "_write_waves", lambda *a: waves.append(write(*a)) or waves[-1])
    data = flow_rows()
    flows = spark.createDataFrame(data, FLOWS)
    got = state.stateful_fold(flows, detections.FLOW, S.flow_fold, (0, 0), S.FLOW_STATE, S.FLOW_OUT, rows=rows, on_close=S.flow_count)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, late_by_hand(data)))
    assert waves == [0]


@pytest.mark.parametrize("rows", [2, 1000])
def test_large_groups_still_go_in_waves(spark, monkeypatch, rows):
    waves, write = [], state._write_waves
    monkeypatch.setattr(state, "_write_waves", lambda *a: waves.append(write(*a)) or waves[-1])
    data = [r for r in flow_rows() if None not in r]
    flows = spark.createDataFrame(data, FLOWS)
    got = state.stateful_fold(flows, detections.FLOW, S.flow_fold, (0, 0), S.FLOW_STATE, S.FLOW_OUT, rows=rows, on_close=S.flow_count, wave_rows=50)
    assert {tuple(r) for r in got.collect()} == late_by_hand(data)
    assert waves[0] > 1 or rows == 1000


def test_many_keys_are_one_call():
    """Calls follow the frames, not the keys."""
    calls = []

    def many(packets, first, before):
        calls.append(len(first))
        return packets.iloc[:0], [before[0] + np.diff(np.append(first, len(packets)))]

    def one(key, packets, before):
        raise AssertionError("a call for one key")

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("epoch", "k", "pkt_no")])
    keyed = KeyedFold(GroupedFold(one, many), lambda key, s: pd.DataFrame([[*key, s[0]]], columns=["epoch", "k", "n"]), ["epoch", "k"], schema, (0,), 100)
    rows = pd.DataFrame({"epoch": 0, "k": np.repeat(np.arange(500), 3), "pkt_no": np.arange(1500), "packet_key_nulls": "", "packet_nulls": ""})
    found = pd.concat(keyed.over_sorted(iter([rows.iloc[:700], rows.iloc[700:]])))
    assert len(calls) == 2 and found["n"].tolist() == [3] * 500


def test_handshakes_of_many_are_those_of_one():
    rng = random.Random(3)
    rows = [(0, rng.randrange(20), no, rng.choice([2, 16, 18]), rng.randrange(4), rng.randrange(4)) for no in range(300)]
    rows = pd.DataFrame(rows, columns=["epoch", "nkey", "pkt_no", "tcp_flags", "tcp_seq", "tcp_ack"]).sort_values(["nkey", "pkt_no"], ignore_index=True)
    first = np.flatnonzero(rows["nkey"] != rows["nkey"].shift())
    before = [np.arange(len(first)), np.arange(len(first)) % 3]
    got, after = S.handshake_fold.many(rows, first, before)
    each = [S.handshake_fold.one((0, k), g.reset_index(drop=True), (i, i % 3)) for i, (k, g) in enumerate(rows.groupby("nkey"))]
    pd.testing.assert_frame_equal(got, pd.concat([e[0] for e in each], ignore_index=True))
    assert [tuple(r) for r in np.array(after).T.tolist()] == [e[1] for e in each]


@pytest.mark.parametrize("fold", [S.flow_fold, S.flow_fold.one])
def test_streamed_keys_share_buckets(spark, fold):
    """All keys of an epoch in three buckets, some keys with nulls, packets of a key in several batches."""
    data = [r for r in flow_rows(n=200) if r[0] is not None]
    path = scratch("flows")
    flows = spark.createDataFrame(data, FLOWS).withColumn("ts", F.timestamp_seconds(F.col("epoch") * 1000 + F.col("pkt_no") + 1))
    end = flows.limit(1).withColumns({"epoch": F.lit(5).cast("long"), "ts": F.timestamp_seconds(F.lit(5500))})
    for i in range(3):
        flows.where(F.col("pkt_no") % 3 == i).coalesce(1).write.mode("append").parquet(path)
    end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "2000 seconds")
    found = stateful_fold_stream(
        stream, detections.FLOW, fold, (0, 0), S.FLOW_STATE, S.FLOW_OUT, 1000, 0, S.flow_count, rows=16, buckets=3
    )
    got = sorted(map(str, map(tuple, windows.run_to_end(found).collect())))
    assert got == sorted(map(str, late_by_hand(data)))


def test_nulls_leave_other_keys_exact(spark):
    """Numbers beyond 2^53 beside a null."""
    df = spark.createDataFrame([(0, BIG, 1), (0, None, 2), (0, BIG + 2, None)], "epoch long, k long, pkt_no long")
    got = without_nulls(df, ["epoch", "k"], "pkt_no").toPandas()
    assert sorted(got["k"]) == [0, BIG, BIG + 2] and got["k"].dtype == "int64"
    assert sorted(got["packet_key_nulls"]) == ["", "", "01"] and sorted(got["packet_nulls"]) == ["", "", "1"]
