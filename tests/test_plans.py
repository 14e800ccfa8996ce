"""Plans have the shape that holds at scale."""

from conftest import SF
from packetloom.operators import aggregate, distinct, joins, sketch
from packetloom.operators.accuracy import AccuracySpec
from packetloom.plans import detections, tuning
from packetloom.plans.fixtures import flows_from_lineitem, packets_from_events

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_packets_are_limited_before_the_shuffle(spark):
    p = packets_from_events(spark, SF)
    for df in (distinct.distinct_first(p, ["dst_addr"]), sketch.bloom_distinct(p, ["dst_addr"], 2, 64)):
        text = plan(df)
        assert "WindowGroupLimit" in text
        assert text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_alerts_are_limited_before_the_shuffle(spark):
    text = plan(detections.alert_packets(packets_from_events(spark, SF), ["dst_addr"], 3))
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_running_values_read_their_input_twice(spark):
    """Once for counts and totals, once for the values."""
    text = plan(aggregate.reduce_running(packets_from_events(spark, SF), ["dst_addr"], "size").select("size"))
    assert text.count("Exchange hashpartitioning") == 3
    assert text.count("BroadcastHashJoin") == 1


def test_register_sizes_share_one_plan(spark):
    """The steps of the plan do not grow with the number of sizes, only with their rows."""
    spec, packets = AccuracySpec(), packets_from_events(spark, SF)
    sizes = [((2, w), (2, v)) for w in (1, 2, 4, 8) for v in (1, 2, 4, 8)]
    two, all_sizes = (
        plan(tuning.evaluate_configs(packets, tuning.SynFloodQuery(2), s, spec, 29)).count("Exchange hashpartitioning")
        for s in (sizes[:2], sizes)
    )
    assert two == all_sizes


def test_owners_and_cell_totals_are_combined_before_the_shuffle(spark):
    p = packets_from_events(spark, SF)
    owners = plan(sketch.fingerprint_owners(p, ["dst_addr"], 2, 64))
    assert "partial_min" in owners and "Window" not in owners
    totals = plan(sketch.reduce_cm(p, ["dst_addr"], "size", 2, 64, "final"))
    assert "Generate" not in totals and "partial_sum" in totals


def test_only_needed_columns_are_read(spark):
    text = plan(detections.superspreader(packets_from_events(spark, SF), 5))
    anchor, scan = [part.split(">")[0] for part in text.split("ReadSchema: struct<")[1:3]]
    assert {c.split(":")[0] for c in anchor.split(",")} == {"event_id", "ts"}
    assert {c.split(":")[0] for c in scan.split(",")} == {"ts", "user_id", "props"}


def test_zip_diff_is_one_shuffle(spark):
    f = flows_from_lineitem(spark, SF)
    diff = joins.zip_diff(f.where("flag = 'R'"), f.where("flag = 'A'"), "dst_addr", "dst_addr", "size", "size")
    assert plan(diff).count("Exchange hashpartitioning") == 1


def test_registers_of_one_key_share_an_exchange(spark):
    text = plan(detections.synflood_counts(packets_from_events(spark, SF), rows=None).select("cnt"))
    assert text.count("Exchange hashpartitioning") == 1


def test_sums_are_combined_before_the_shuffle(spark):
    text = plan(detections.newconn(packets_from_events(spark, SF), 3))
    assert "partial_sum" in text or "partial_count" in text
    assert text.count("Exchange hashpartitioning") == 1
