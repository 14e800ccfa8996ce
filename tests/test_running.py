"""Running values with hot groups cut into segments, against a plain loop."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F, types as T

from packetloom.operators import aggregate, running as R, state
from packetloom.plans import detections


def collect(df, *cols):
    return {r["pkt_no"]: tuple(r[c] for c in cols) for r in df.select("pkt_no", *cols).collect()}


def rows_of(packets):
    return sorted(packets.collect(), key=lambda r: r["pkt_no"])


@pytest.mark.parametrize("rows", [None, 7, 64, 1000])
def test_all_scans(packets, rows):
    value = F.col("size")
    marked = F.when(F.col("tcp_flags") == 18, value)
    scans = {
        "total": R.running_sum(value),
        "last": R.running_last(marked),
        "top": R.running_max(value),
        "before": R.max_before(value),
        "prev": R.previous(value),
    }
    got = collect(R.running(packets, ["epoch", "dst_addr"], scans, rows=rows), *scans)
    seen = defaultdict(list)
    assert len(got) == 600
    for r in rows_of(packets):
        past = seen[r["epoch"], r["dst_addr"]]
        earlier = [p["size"] for p in past]
        past.append(r)
        marks = [p["size"] for p in past if p["tcp_flags"] == 18]
        assert got[r["pkt_no"]] == (
            sum(p["size"] for p in past),
            marks[-1] if marks else None,
            max(p["size"] for p in past),
            max(earlier) if earlier else None,
            earlier[-1] if earlier else None,
        )


def test_hot_groups_are_cut_and_others_are_not(packets):
    cut = R.split_hot(packets, ["epoch", "dst_addr"], rows=40)
    sizes = cut.groupBy("epoch", "dst_addr", "segment").count().collect()
    assert max(r["count"] for r in sizes) <= 40
    assert {r["dst_addr"] for r in sizes if r["segment"] >= 0} == {1}
    assert sum(r["count"] for r in sizes) == 600


def test_over_the_whole_trace(packets):
    got = collect(R.running_over_all(packets, {"top": R.running_max(F.col("size"))}, rows=50), "top")
    top = 0
    for r in rows_of(packets):
        top = max(top, r["size"])
        assert got[r["pkt_no"]] == (top,)


@pytest.mark.parametrize("rows", [None, 25])
def test_crossing_fires_once(packets, rows):
    hits = aggregate.threshold_crossing(packets, ["dst_addr"], "size", 50, rows=rows).collect()
    total, want = defaultdict(int), []
    for r in rows_of(packets):
        key = r["epoch"], r["dst_addr"]
        before = total[key]
        total[key] += r["size"]
        if before < 50 <= total[key]:
            want.append(r["pkt_no"])
    assert sorted(h["pkt_no"] for h in hits) == want


def flood_by_hand(packets):
    nextseq, cnt, out = defaultdict(int), defaultdict(int), {}
    for r in rows_of(packets):
        if not r["tcp_flags"] & 16:
            continue
        syn_ack = r["tcp_flags"] == 18
        key = (r["epoch"], r["src_addr"] if syn_ack else r["dst_addr"])
        flag = 1 if syn_ack else 0
        if syn_ack:
            nextseq[key] = r["tcp_seq"] + 1
        if nextseq[key] == r["tcp_ack"]:
            flag = 2
        cnt[key] += {0: 0, 1: 1, 2: -1}[flag]
        out[r["pkt_no"]] = (key[1], cnt[key])
    return out


@pytest.mark.parametrize("rows", [None, 10, 1 << 22])
def test_chained_registers(packets, rows):
    got = collect(detections.synflood_counts(packets, rows=rows), "nkey", "cnt")
    assert got == flood_by_hand(packets)


@pytest.mark.parametrize("rows", [9, 1000])
def test_fold_in_pieces(spark, packets, rows):
    from packetloom.streaming import detections as S

    hs = detections.handshake_packets(packets)
    folded = state.stateful_fold(
        hs, ["nkey"], S.handshake_fold, (0, 0), S.HANDSHAKE_STATE, S.HANDSHAKE_OUT, rows=rows
    )
    assert collect(folded, "nkey", "cnt") == flood_by_hand(packets)


def test_waves_follow_the_size_of_a_group(spark):
    """A key spread over many packet numbers takes as few waves as one in a row."""
    from packetloom.operators.state import _write_waves

    hot = spark.range(120).selectExpr("id * 50 AS pkt_no", "0L AS epoch", "1L AS k")
    from conftest import scratch

    assert _write_waves(hot, ["epoch", "k"], "pkt_no", 100, scratch("waves")) == 2
    assert _write_waves(hot.limit(0), ["epoch", "k"], "pkt_no", 100, scratch("none")) == 0


def test_fold_says_its_last_word_once(packets):
    import pandas as pd

    def total(key, rows, before):
        return rows.iloc[:0], (before[0] + int(rows["size"].sum()),)

    one = T.StructType([T.StructField("total", T.LongType())])
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("epoch", "dst_addr", "total")])
    for rows in (9, 1000):
        got = state.stateful_fold(
            packets, ["dst_addr"], total, (0,), one, out, rows=rows,
            on_close=lambda key, reg: pd.DataFrame([[*key, reg[0]]], columns=out.names),
        )
        want = packets.groupBy("epoch", "dst_addr").agg(F.sum("size"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def cases():
    return [
        (F.col("tcp_flags") == 2, "=", F.col("tcp_seq") - 2),
        (F.col("tcp_flags") == 18, "+=", -F.col("tcp_ack")),
        (F.col("tcp_flags") == 17, "max=", F.col("size") - 4),
        (F.col("tcp_flags") == 24, "+=", F.col("size")),
    ]


@pytest.mark.parametrize("rows", [None, 7, 64, 1000])
def test_branches_compose(packets, rows):
    """Assigned, added to and raised: equal to the general fold, hot keys cut or not, and native."""
    def branch_register(key, frame, before):
        """The same register, packet by packet."""
        (reg,), out = before, []
        for r in frame.itertuples():
            if r.tcp_flags == 2:
                reg = r.tcp_seq - 2
            elif r.tcp_flags == 18:
                reg -= r.tcp_ack
            elif r.tcp_flags == 17:
                reg = max(reg, r.size - 4)
            elif r.tcp_flags == 24:
                reg += r.size
            out.append(int(reg))
        return frame[["pkt_no"]].assign(reg=out), (int(reg),)

    found = state.state_branches(packets, ["dst_addr"], cases(), "reg", rows=rows)
    numbers = T.StructType([T.StructField(n, T.LongType()) for n in ("pkt_no", "reg")])
    one = T.StructType([T.StructField("reg", T.LongType())])
    want = state.stateful_fold(packets, ["dst_addr"], branch_register, (0,), one, numbers)
    assert collect(found, "reg") == collect(want, "reg")
    assert len(collect(found, "reg")) == 600
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_branches_name_their_step(packets):
    with pytest.raises(ValueError, match="a branch assigns"):
        state.state_branches(packets, ["dst_addr"], [(F.lit(True), "-=", "size")], "reg")
