"""Metrics, the gate, resource scores and the size search."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import accuracy, epochs
from packetloom.operators.accuracy import AccuracySpec
from packetloom.operators.distinct import distinct_first
from packetloom.operators.sketch import bloom_distinct, cells_per_row, heavy_keys_cm
from packetloom.plans import detections, tuning


def sets(spark, pairs, columns="epoch long, k long"):
    return spark.createDataFrame(pairs, columns)


def test_empty_epochs(spark):
    est = sets(spark, [(0, 1), (0, 2), (2, 5)])
    exact = sets(spark, [(0, 1), (0, 3), (0, 4), (1, 9)])
    rows = accuracy.precision_recall(est, exact, ["k"], 4).orderBy("epoch").collect()
    got = [(r["n_est"], r["n_exact"], r["n_correct"], r["precision"], round(r["recall"], 4)) for r in rows]
    assert got == [(2, 3, 1, 0.5, 0.3333), (0, 1, 0, 1.0, 0.0), (1, 0, 0, 0.0, 1.0), (0, 0, 0, 1.0, 1.0)]


def test_relative_error(spark):
    est = sets(spark, [(0, 1, 12), (0, 9, 5)], "epoch long, k long, v long")
    exact = sets(spark, [(0, 1, 10), (0, 2, 7)], "epoch long, k long, v long")
    rows = accuracy.relative_error(est, exact, ["k"], "v", 2).orderBy("epoch").collect()
    assert [round(r["are"], 6) for r in rows] == [0.6, 0.0]


@pytest.mark.parametrize("n,c,rank", [(50, 0.9, 44), (10, 0.85, 7), (1, 0.9, 0), (2, 0.1, 0)])
def test_gate_rank(n, c, rank):
    assert accuracy.gate_rank(n, c) == rank


def test_gate_takes_order_statistics(spark):
    rows = [(i, 10, 1.0 - i / 100, i / 100, i / 10) for i in range(10)]
    m = spark.createDataFrame(rows, "epoch long, n_exact long, precision double, recall double, are double")
    spec = AccuracySpec(0.9, 0.0, 0.5, are_max=0.4)
    r = accuracy.confidence_gate(m, spec, 10).first()
    assert (r["precision"], r["recall"], r["are"], r["avg_keys"], r["success"]) == (0.96, 0.05, 0.4, 10.0, True)
    spec = AccuracySpec(0.9, 0.06, 0.5, are_max=0.4)
    assert accuracy.confidence_gate(m, spec, 10).first()["success"] is False


def test_short_trace_fails(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "epoch long")
    assert sorted(r[0] for r in epochs.complete_epochs(df, 2).collect()) == [0, 1]
    assert sorted(r[0] for r in epochs.complete_epochs(df).collect()) == [0, 1]
    with pytest.raises(Exception, match="ends in epoch 2 of 3"):
        epochs.complete_epochs(df, 3).collect()


def test_score_and_limits(spark):
    query = tuning.CountQuery("dst_addr", 3, ("dst_addr", "src_addr"))
    configs = [((2, 8), (2, 8)), ((3, 16), (1, 1)), ((1, 47), (4, 11)), ((1, 48), (1, 1)), ((5, 1), (1, 1))]
    table = tuning.config_table(spark, configs, query)
    scores = {r["conf_id"]: r["score"] for r in tuning.resource_score(table).collect()}
    assert scores[0] == pytest.approx(0.4 * 4 / 8 + 0.3 * (32 + 4) / 96 + 0.3 * 8 / 32)
    assert scores[1] == pytest.approx(0.4 * 4 / 8 + 0.3 * (49 + 4) / 96 + 0.3 * 8.5 / 32)
    valid = {r[0] for r in tuning.valid_conf(table).collect()}
    assert valid == {0, 2}
    limits = tuning.Limits()
    assert valid == {i for i, c in enumerate(configs) if all(tuning._fits(p, limits) for p in c)}


def test_sizing_fails_on_a_short_trace(packets):
    query, spec = tuning.CountQuery("dst_addr", 5), AccuracySpec(0.0, 0.0, 0.5)
    for n in (3, 300):
        with pytest.raises(Exception, match="the trace ends in epoch 2"):
            tuning.evaluate_configs(packets, query, [((1, 1),)], spec, n).collect()
        with pytest.raises(Exception, match="the trace ends in epoch 2"):
            tuning.accuracy_report(packets, query, ((1, 1),), spec, n).collect()
        with pytest.raises(Exception, match="the trace ends in epoch 2"):
            tuning.tune_sketch(packets, query, spec, n)
    with pytest.raises(Exception, match="the trace ends in epoch -1"):
        tuning.accuracy_report(packets.limit(0), query, ((1, 1),), spec, 2).collect()


def test_error_of_zeros_and_negative_values(spark):
    est = sets(spark, [(0, 1, 0), (0, 2, 3), (0, 3, 2)], "epoch long, k long, v long")
    exact = sets(spark, [(0, 1, 0), (0, 2, 0), (0, 3, -4)], "epoch long, k long, v long")
    assert accuracy.relative_error(est, exact, ["k"], "v", 1).first()["are"] == pytest.approx((0 + 1 + 1.5) / 3)


def test_relative_error_bounds_a_size(packets):
    query = tuning.CountQuery("dst_addr", 20, value="size")
    for are_max, width in ((0.0, 64), (100.0, 1)):
        spec = AccuracySpec(0.0, 0.0, 0.9, are_max=are_max)
        row = tuning.accuracy_report(packets, query, ((2, width),), spec, 2, page_bytes=32).first()
        assert row["success"] and (row["are"] > 0) == (width == 1)
    with pytest.raises(ValueError, match="relative error"):
        tuning.accuracy_report(packets, tuning.SynFloodQuery(2), ((1, 1), (1, 1)), AccuracySpec(are_max=1.0), 2)


@pytest.mark.parametrize("rows", [None, 10])
def test_many_configs_equal_one_by_one(packets, rows):
    query = tuning.CountQuery("dst_addr", 3, ("dst_addr", "src_addr"))
    configs = [((1, 1), (1, 1)), ((2, 2), (3, 2)), ((4, 1), (2, 4))]
    page = 4
    first = query.first_packets(packets, 2)
    packets = packets.where("epoch < 2")
    got = {tuple(r)[:3] for r in query.reports(first, configs, page, rows).collect()}
    want = set()
    for i, (b, c) in enumerate(configs):
        passed = bloom_distinct(packets, ["dst_addr", "src_addr"], b[0], cells_per_row(b[1], 1, page))
        ones = passed.withColumn("one", F.lit(1))
        heavy = heavy_keys_cm(ones, ["dst_addr"], "one", c[0], cells_per_row(c[1], 32, page), 3)
        want |= {(i, r["epoch"], r["dst_addr"]) for r in heavy.collect()}
    assert got == want
    exact = distinct_first(packets, ["dst_addr", "src_addr"]).groupBy("epoch", "dst_addr").count().where("count >= 3")
    assert {tuple(r) for r in query.exact(first).collect()} == {
        (r["epoch"], r["dst_addr"], r["count"]) for r in exact.collect()
    }


def test_search_finds_a_passing_size(packets):
    packets = packets.withColumn("epoch", F.floor(F.col("pkt_no") / 150))
    query = tuning.CountQuery("dst_addr", 5, ("dst_addr", "src_addr"))
    spec = AccuracySpec(0.9, 0.9, 0.9)
    best = tuning.tune_sketch(packets, query, spec, 3, page_bytes=32).collect()
    sizes = {r["table"]: (r["d"], r["w"]) for r in best}
    config = (sizes["distinct"], sizes["count"])
    assert tuning.accuracy_report(packets, query, config, spec, 3, page_bytes=32).first()["success"]
    for i, (d, w) in enumerate(config):
        for pair in ((d - 1, w), (d, w // 2)):
            if all(pair):
                smaller = (*config[:i], pair, *config[i + 1 :])
                assert not tuning.accuracy_report(packets, query, smaller, spec, 3, page_bytes=32).first()["success"]


@pytest.mark.parametrize("page", [8, 16, 32])
def test_search_judges_few_sizes_and_finds_the_cheapest(packets, monkeypatch, page):
    packets = packets.withColumn("epoch", F.floor(F.col("pkt_no") / 150))
    query = tuning.CountQuery("dst_addr", 5, ("dst_addr", "src_addr"))
    spec, limits = AccuracySpec(0.9, 0.9, 0.9), tuning.Limits(alu_max=2, page_max=4)
    every = tuning.all_configs(2, limits)
    assert every == sorted(every, key=lambda c: (round(tuning.cost(c, limits), 12), c)) and len(every) == 36
    judged = []
    inner = tuning._judge
    monkeypatch.setattr(tuning, "_judge", lambda first, query, configs, *a: judged.extend(configs) or inner(first, query, configs, *a))
    best = tuning.tune_sketch(packets, query, spec, 3, limits, page, wave_size=4).collect()
    assert len(set(judged)) == len(judged) < len(every)
    whole = tuning.evaluate_configs(packets, query, every, spec, 3, limits, page).collect()
    passing = sorted(r["conf_id"] for r in whole if r["success"])
    scores = {r["conf_id"]: r["score"] for r in whole}
    sizes = {r["table"]: (r["d"], r["w"]) for r in best}
    found = every.index((sizes["distinct"], sizes["count"]))
    assert best[0]["success"] == bool(passing)
    assert found == (passing[0] if passing else every.index(((2, 4), (2, 4))))
    assert best[0]["score"] == pytest.approx(scores[found])


def test_search_without_answer(packets):
    query = tuning.CountQuery("dst_addr", 5, ("dst_addr", "src_addr"))
    rows = tuning.tune_sketch(packets, query, AccuracySpec(1.1, 1.1, 0.9), 2, tuning.Limits(alu_max=1, page_max=1), 32).collect()
    assert {(r["table"], r["d"], r["w"], r["success"]) for r in rows} == {("distinct", 1, 1, False), ("count", 1, 1, False)}


def test_staircase_closes_what_a_verdict_settles():
    import random

    rng = random.Random(2)
    limits = tuning.Limits()
    configs = tuning.all_configs(2, limits)
    for _ in range(30):
        need = [rng.choice([1, 2, 3, 4]), rng.choice([1, 2, 8, 32, 64]), rng.choice([1, 2, 4]), rng.choice([1, 4, 16])]
        passes = lambda c: all(x >= n for x, n in zip((v for pair in c for v in pair), need))
        steps, n = tuning.Staircase(configs), 0
        while wave := steps.wave(16):
            n += len(wave)
            for i in wave:
                steps.settle(i, passes(configs[i]))
        want = next((i for i, c in enumerate(configs) if passes(c)), None)
        assert steps.best == want
        assert n < len(configs) / 3


def test_filters_fold_down_from_the_finest(packets):
    """As many packet rows for four widths as for one; each table as if it were built alone."""
    assert tuning.finest([8, 2, 4, 6, 3]) == {8: [8, 4, 2], 6: [6, 3]}
    first = tuning.CountQuery("dst_addr", 3, ("dst_addr", "src_addr")).first_packets(packets, 2)
    from packetloom.functions.hashing import with_row_hashes

    hashed = with_row_hashes(first, ["dst_addr", "src_addr"], 3, "_h")
    got = {tuple(r) for r in tuning.first_touches(first, ["dst_addr", "src_addr"], [(3, 24), (2, 12), (1, 6), (1, 9)], []).collect()}
    want = set()
    for width in (24, 12, 6, 9):
        for i in range(3):
            touched = hashed.groupBy("epoch", (F.col(f"_h{i}") % width).alias("cell")).agg(F.min("pkt_no").alias("pkt_no"))
            want |= {(r["epoch"], r["pkt_no"], i, r["cell"], width) for r in touched.collect()}
    assert {(e, n, row, cell, width) for e, n, row, cell, width in got} == want

    def spread(sizes):
        plan = tuning.first_touches(first, ["dst_addr", "src_addr"], sizes, [])._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Generate inline"), plan[plan.index("Generate inline") :].split("\n")[0].count("cell")

    assert spread([(2, 24)]) == spread([(2, 24), (2, 12), (1, 6), (2, 3)])


def test_register_query_in_many_sizes(packets):
    query = tuning.SynFloodQuery(2)
    configs = [((1, 1), (1, 2)), ((2, 2), (2, 2)), ((2, 1), (1, 4))]
    first = query.first_packets(packets, 2)
    packets = packets.where("epoch < 2")
    got = {tuple(r) for r in query.reports(first, configs, 16, 25).collect()}
    want = set()
    for i, (a, b) in enumerate(configs):
        sizes = [(d, cells_per_row(w, 32, 16)) for d, w in (a, b)]
        want |= {(i, *r) for r in map(tuple, detections.synflood_cells(packets, *sizes, 2).collect())}
    assert got == want and want
