"""Streams in several micro-batches give the batch answer for closed epochs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from conftest import SF
from packetloom.plans import detections
from packetloom.plans.fixtures import DAY_SECONDS, packet_columns, packets_from_events
from packetloom.operators.epochs import with_epoch
from packetloom.streaming import detections as S, report, windows
from packetloom.streaming.state import merged_runs, stateful_fold_stream


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events in ten files, in event order, one micro-batch each."""
    path = str(tmp_path_factory.mktemp("events") / "e")
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(10):
        events.where(f"event_id >= {i * 100} AND event_id < {i * 100 + 100}").coalesce(1).write.mode("append").parquet(path)
    start_us = events.select(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]

    def stream():
        raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)
        return packet_columns(raw)

    return stream, start_us


def closed(df, last):
    return {tuple(r) for r in df.where(F.col("epoch") < last).collect()}


@pytest.mark.parametrize("name,n", [("newconn", 2), ("ddos", 2), ("superspreader", 3)])
def test_window_detections(spark, split_events, name, n):
    stream, start_us = split_events
    batch = packets_from_events(spark, SF)
    last = batch.agg(F.max("epoch")).first()[0]
    got = windows.run_to_end(getattr(S, name)(stream(), n, DAY_SECONDS, start_us, watermark="0 seconds"))
    want = getattr(detections, name)(batch, n)
    assert {tuple(r) for r in got.collect()} == closed(want, last)


def test_registers(spark, split_events):
    stream, start_us = split_events
    got = windows.run_to_end(S.synflood_counts(stream(), DAY_SECONDS, start_us, watermark="0 seconds"))
    want = detections.synflood_counts(packets_from_events(spark, SF))
    columns = ["epoch", "pkt_no", "nkey", "nextseq", "cnt"]
    assert {tuple(r) for r in got.select(columns).collect()} == {tuple(r) for r in want.select(columns).collect()}


def test_results_at_the_end_of_an_epoch(spark, split_events):
    stream, start_us = split_events
    batch = packets_from_events(spark, SF)
    last = batch.agg(F.max("epoch")).first()[0]
    got = windows.run_to_end(S.tcp_nonmonotonic(stream(), DAY_SECONDS, start_us, watermark="0 seconds"))
    assert {tuple(r) for r in got.collect()} == closed(detections.tcp_nonmonotonic(batch), last)


def test_alerts(spark, split_events):
    stream, start_us = split_events
    syn = detections.syn_packets(stream())
    got = windows.run_to_end(S.alert_packets(syn, ["dst_addr"], 2, DAY_SECONDS, start_us, watermark="0 seconds"))
    want = detections.alert_packets(detections.syn_packets(packets_from_events(spark, SF)), ["dst_addr"], 2)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(got.columns).collect()}


def test_runs_merge_in_order():
    runs = {(1, 0): [1, 4, 9], (2, 1): [2, 3], (9, 2): [9, 10], (20, 3): [20]}
    loaded = []

    def load(name):
        loaded.append(name)
        return pd.DataFrame({"pkt_no": runs[name]})

    frames = [f["pkt_no"].tolist() for f in merged_runs(list(runs), load, "pkt_no")]
    assert sum(frames, []) == [1, 2, 3, 4, 9, 9, 10, 20]

    loaded.clear()
    merge = merged_runs(list(runs), load, "pkt_no")
    assert next(merge)["pkt_no"].tolist() == [1]
    assert next(merge)["pkt_no"].tolist() == [2, 3, 4]
    assert merge.send(True)["pkt_no"].tolist() == [9]
    assert (20, 3) not in loaded and (9, 2) not in loaded


@pytest.fixture(scope="module")
def swapped_events(spark, tmp_path_factory):
    """Events of a few keys in eight files: every other event comes one or two files late."""
    path = str(tmp_path_factory.mktemp("swapped") / "e")
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 400")
    late = events.withColumn("part", F.floor(F.col("event_id") / 50) + F.when(F.col("event_id") % 2 == 1, F.col("event_id") % 3).otherwise(0))
    for i in range(10):
        late.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    # Packets of all kinds far behind move the watermark past all others.
    events.where("event_id >= 340").withColumn("ts", F.expr("ts + INTERVAL 40 DAYS")).withColumn(
        "event_id", (F.col("event_id") + 10_000).cast(events.schema["event_id"].dataType)
    ).coalesce(1).write.mode("append").parquet(path)
    start_us = events.select(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]

    def stream(files=1):
        return packet_columns(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path))

    return stream, packet_columns(events), start_us


@pytest.mark.parametrize("rows", [3, 1 << 14])
def test_packets_that_come_late_are_folded_in_order(spark, swapped_events, rows):
    """A fold that depends on the order, in small pieces and in large ones."""
    stream, packets, start_us = swapped_events

    def chain(key, rows_now, before):
        assert len(rows_now) <= rows
        links, last = [], before[0]
        for n in rows_now["pkt_no"]:
            links.append(last)
            last = int(n)
        return rows_now[["epoch", "pkt_no"]].assign(previous=links), (last,)

    state = T.StructType([T.StructField("last", T.LongType())])
    out = T.StructType([T.StructField(n, T.LongType()) for n in ("epoch", "pkt_no", "previous")])
    month = 30 * DAY_SECONDS
    numbered = windows.numbered_epoch(stream(), month, "30 days", start_us).withColumn("key", F.lit(1))
    slim = numbered.select("epoch", "ts", "key", F.col("pkt_no").cast("long").alias("pkt_no"))
    chained = stateful_fold_stream(slim, ["key"], chain, (-1,), state, out, month, start_us, rows=rows)
    got = {tuple(r)[1:] for r in windows.run_to_end(chained).where("pkt_no < 10000").collect()}
    numbers = sorted(r[0] for r in packets.select("pkt_no").collect())
    assert got == set(zip(numbers, [-1, *numbers]))


def test_detections_with_late_packets(spark, swapped_events):
    stream, packets, start_us = swapped_events
    batch = with_epoch(packets, DAY_SECONDS)
    got = windows.run_to_end(S.tcp_nonmonotonic(stream(), DAY_SECONDS, start_us, watermark="30 days"))
    want = {tuple(r) for r in detections.tcp_nonmonotonic(batch).collect()}
    assert {tuple(r) for r in got.where("epoch < 32").collect()} == want
    columns = ["epoch", "pkt_no", "nkey", "nextseq", "cnt"]
    got = windows.run_to_end(S.synflood_counts(stream(), DAY_SECONDS, start_us, watermark="30 days"))
    want = detections.synflood_counts(batch)
    assert {tuple(r) for r in got.select(columns).where("epoch < 32").collect()} == {tuple(r) for r in want.select(columns).collect()}


def test_report_names_empty_epochs_and_replaces_a_replayed_batch(spark, split_events, tmp_path):
    stream, start_us = split_events
    path, progress = str(tmp_path / "report"), str(tmp_path / "progress")
    hour = 3600.0

    def run():
        report.report_stream(
            stream(), lambda p: detections.newconn(p, 1, by=windows.WINDOW), ["dst_addr"], path, progress,
            hour, start_us, watermark="0 seconds", available_now=True,
        ).awaitTermination()
        epochs = [tuple(r) for r in report.read_report(spark, path).collect()]
        found = [tuple(r) for r in report.read_found(spark, path, keys).collect()]
        return sorted(epochs), sorted(found, key=str)

    keys = T.StructType([T.StructField("dst_addr", T.LongType())])
    packets = with_epoch(packets_from_events(spark, SF).drop("epoch"), hour)
    counts = dict(tuple(r) for r in packets.groupBy("epoch").count().collect())
    last = max(e for e in counts if e < max(counts))
    syn = {tuple(r) for r in detections.newconn(packets, 1).collect() if r[0] <= last}
    want_epochs = [(e, counts.get(e, 0)) for e in range(last + 1)]
    want_found = syn | {(e, None) for e in range(last + 1) if e not in {s[0] for s in syn}}
    assert 0 in dict(want_epochs).values()

    epochs, found = run()
    assert epochs == want_epochs and set(found) == want_found and len(found) == len(want_found)

    # The last commit gets lost: the restarted stream runs its batch again.
    batches = {r[0] for r in spark.read.parquet(f"{path}/epochs").select("batch").distinct().collect()}
    lost = max(batches)
    shadow = tmp_path / "lost"
    shadow.mkdir()
    for c in list((tmp_path / "progress" / "commits").iterdir()):
        number = c.name.strip(".").removesuffix(".crc")  # checksums lie beside the commits
        if number.isdigit() and int(number) >= lost:
            c.rename(shadow / c.name)
    assert run() == (epochs, found)
