"""Every operator as a query over the test tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from packetloom.functions import scalar
from packetloom.functions.hashing import explode_cells
from packetloom.operators import accuracy, aggregate, basic, distinct, epochs, joins, sketch, state
from packetloom.operators.accuracy import AccuracySpec
from packetloom.operators.folds import GroupedFold
from packetloom.plans import captures, detections, oracles as sql, tuning
from packetloom.plans.fixtures import DAY_SECONDS, flows_from_lineitem, packet_stream, packets_from_events
from packetloom.schema import EPOCH, ORDER
from packetloom.sources import config as sketch_config, decode, flowtext, pcap, trace
from packetloom.sources.shared import shared_dir
from packetloom.streaming import detections as stream_detections, report as stream_report, windows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and doubles rounded, so that both engines print alike."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, oracle: str | None = None):
    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # The tables hold UTC times without a zone.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def on_packets(name: str, body: str | None = None, *ctes: str):
    """Register a query on packets; ``body`` is its SQL over a ``packets`` table."""

    def keep(fn):
        oracle = None if body is None else sql.with_packets(body, *ctes)
        register(name, oracle)(lambda spark, sf_dir: fn(packets_from_events(spark, sf_dir)))
        return fn

    return keep


NO_DELAY = "0 seconds"  # the events come in order


# --- projections, filters, tags -------------------------------------------------


@on_packets(
    "p1_filter_cmp",
    "SELECT pkt_no, epoch, dst_addr, dport FROM packets WHERE proto = 6 AND tcp_flags <> 2 AND dport <= 20"
    " AND dport > 2 AND size >= 60 AND size < 900",
)
def p1(p):
    for left, op, right in [
        ("ipv4.protocol", "eq", "IP_PROTOCOLS_TCP"),
        ("tcp.flags", "ne", "TCP_FLAG_SYN"),
        ("tcp.dport", "le", 20),
        ("tcp.dport", "gt", 2),
        ("size", "ge", 60),
        ("size", "lt", 900),
    ]:
        p = basic.filter_cmp(p, left, op, right)
    return p.select("pkt_no", "epoch", "dst_addr", "dport")


@on_packets("p2_filter_bit_and", "SELECT pkt_no, tcp_flags FROM packets WHERE (tcp_flags & 16) <> 0")
def p2(p):
    return basic.filter_cmp(p, "tcp.flags", "bit_and", "TCP_FLAG_ACK").select("pkt_no", "tcp_flags")


@on_packets(
    "p3_named_fields",
    "SELECT pkt_no, dport, tcp_seq FROM packets WHERE proto = 17 AND dport >= tcp_seq",
)
def p3(p):
    p = basic.filter_cmp(p, "ipv4.protocol", "eq", "IP_PROTOCOLS_UDP")
    return basic.filter_cmp(p, "tcp.dst_port", "ge", "tcp.seq").select("pkt_no", "dport", "tcp_seq")


@on_packets("p4_map_keys", "SELECT epoch, pkt_no, dst_addr, dport FROM packets")
def p4(p):
    return basic.map_cols(p, ["ipv4.dst_addr", "tcp.dport"])


@on_packets("p5_map_constant", "SELECT epoch, pkt_no, dst_addr, 1 AS count FROM packets")
def p5(p):
    return basic.map_cols(p, ["ipv4.dst_addr", "count"], {"count": 1})


def syn_fin(p):
    syn = detections.syn_packets(p).select(EPOCH, "dst_addr", F.lit(1).alias("syn"))
    fin = detections.flag_counts(p, "TCP_FLAG_FIN", "fin")
    return syn, fin


SYN_FIN = """
syn AS (SELECT epoch, dst_addr, 1 AS v FROM packets WHERE proto = 6 AND tcp_flags = 2),
fin AS (SELECT epoch, dst_addr, 1 AS v FROM packets WHERE proto = 6 AND (tcp_flags & 1) <> 0),
sums AS (
  SELECT coalesce(s.epoch, f.epoch) AS epoch, coalesce(s.dst_addr, f.dst_addr) AS dst_addr, s.n AS syn, f.n AS fin
  FROM (SELECT epoch, dst_addr, count(*) AS n FROM syn GROUP BY ALL) s
  FULL JOIN (SELECT epoch, dst_addr, count(*) AS n FROM fin GROUP BY ALL) f
  ON s.epoch = f.epoch AND s.dst_addr = f.dst_addr)"""


def zipped(p):
    syn, fin = syn_fin(p)
    return joins.zip_streams(
        aggregate.reduce_sum(syn, ["dst_addr"], "syn"),
        aggregate.reduce_sum(fin, ["dst_addr"], "fin"),
        "ipv4.dst_addr",
        "ipv4.dst_addr",
    )


@on_packets(
    "p6_map_diff",
    "SELECT epoch, dst_addr, syn - fin AS diff FROM sums WHERE syn IS NOT NULL AND fin IS NOT NULL",
    SYN_FIN,
)
def p6(p):
    return basic.map_cols(zipped(p), ["ipv4.dst_addr"], {"diff": {"op": "diff", "values": ["syn", "fin"]}})


def three_queries():
    return {
        "newconn": (F.col("proto") == 6) & (F.col("tcp_flags") == 2),
        "acks": F.col("tcp_flags").bitwiseAND(16) != 0,
        "low_ports": F.col("dport") < 10,
    }


MASK = """
masked AS (
  SELECT *, CAST((CASE WHEN proto = 6 AND tcp_flags = 2 THEN 1 ELSE 0 END)
            + (CASE WHEN (tcp_flags & 16) <> 0 THEN 2 ELSE 0 END)
            + (CASE WHEN dport < 10 THEN 4 ELSE 0 END) AS BIGINT) AS query_mask FROM packets)"""


@on_packets("p7_tag_queries", "SELECT pkt_no, query_mask FROM masked WHERE query_mask <> 0", MASK)
def p7(p):
    return basic.tag_queries(p, three_queries()).select("pkt_no", "query_mask")


@on_packets(
    "p7_tagged_counts",
    "SELECT q.query, epoch, count(*) AS n FROM masked JOIN (VALUES ('newconn', 1), ('acks', 2), ('low_ports', 4))"
    " q(query, bit) ON (query_mask & bit) <> 0 GROUP BY ALL",
    MASK,
)
def p7b(p):
    return basic.by_query(p, three_queries()).groupBy("query", EPOCH).agg(F.count(F.lit(1)).alias("n"))


# --- de-duplication ---------------------------------------------------------------


@on_packets(
    "d1_distinct_first",
    "SELECT epoch, pkt_no, src_addr, dst_addr, size FROM packets"
    " QUALIFY row_number() OVER (PARTITION BY epoch, src_addr, dst_addr ORDER BY pkt_no) = 1",
)
def d1(p):
    return distinct.distinct_first(p, ["ipv4.dst_addr", "ipv4.src_addr"]).select(
        "epoch", "pkt_no", "src_addr", "dst_addr", "size"
    )


@on_packets("d2_distinct_keys", "SELECT DISTINCT epoch, src_addr, dst_addr FROM packets")
def d2(p):
    return distinct.distinct_keys(p, ["ipv4.dst_addr", "ipv4.src_addr"])


BLOOM = sql.bloom("packets", ["dst_addr", "src_addr"], 2, 256)


@on_packets(
    "d3_bloom_distinct_5_rows",
    f"SELECT epoch, pkt_no FROM {sql.bloom('packets', ['dst_addr', 'src_addr'], 5, 512)}",
)
def d3_5(p):
    return sketch.bloom_distinct(p, ["dst_addr", "src_addr"], 5, 512).select("epoch", "pkt_no")


@on_packets("d3_bloom_distinct", f"SELECT epoch, pkt_no, src_addr, dst_addr FROM {BLOOM}")
def d3(p):
    return sketch.bloom_distinct(p, ["dst_addr", "src_addr"], 2, 256).select(
        "epoch", "pkt_no", "src_addr", "dst_addr"
    )


# --- aggregations -----------------------------------------------------------------


@on_packets("a1_reduce_sum", "SELECT epoch, dst_addr, CAST(sum(size) AS BIGINT) AS size FROM packets GROUP BY ALL")
def a1(p):
    return aggregate.reduce_sum(p, ["ipv4.dst_addr"], "size")


@register(
    "a1_reduce_sum_flows",
    f"WITH {sql.FLOWS} SELECT epoch, src_addr, CAST(sum(size) AS BIGINT) AS size FROM flows GROUP BY ALL",
)
def a1_flows(spark, sf_dir):
    return aggregate.reduce_sum(flows_from_lineitem(spark, sf_dir), ["src_addr"], "size")


RUN = f"sum(size) OVER (PARTITION BY epoch, dst_addr {sql.RUNNING})"


@on_packets("a2_reduce_running", f"SELECT epoch, pkt_no, dst_addr, CAST({RUN} AS BIGINT) AS total FROM packets")
def a2(p):
    run = aggregate.reduce_running(p, ["ipv4.dst_addr"], "size", "total")
    return run.select("epoch", "pkt_no", "dst_addr", "total")


@on_packets(
    "a3_threshold",
    "SELECT epoch, dst_addr, CAST(sum(size) AS BIGINT) AS size FROM packets GROUP BY ALL HAVING sum(size) > 3000",
)
def a3(p):
    return aggregate.threshold(aggregate.reduce_sum(p, ["dst_addr"], "size"), "size", "gt", 3000)


@on_packets(
    "a4_threshold_crossing",
    f"SELECT epoch, pkt_no, dst_addr, CAST(running AS BIGINT) AS running FROM (SELECT *, {RUN} AS running FROM packets)"
    " WHERE running >= 1500 AND running - size < 1500",
)
def a4(p):
    hit = aggregate.threshold_crossing(p, ["dst_addr"], "size", 1500)
    return hit.select("epoch", "pkt_no", "dst_addr", "running")


CM_RUNNING = sql.cm_running("packets", ["dst_addr"], "size", 2, 16)
CM_FINAL = sql.cm_final("packets", ["dst_addr"], "size", 2, 16)


@on_packets("a5_reduce_cm", f"SELECT epoch, pkt_no, dst_addr, estimate FROM {CM_RUNNING}")
def a5(p):
    return sketch.reduce_cm(p, ["dst_addr"], "size", 2, 16).select("epoch", "pkt_no", "dst_addr", "estimate")


@on_packets("a5_reduce_cm_final", f"SELECT epoch, dst_addr, estimate FROM {CM_FINAL}")
def a5_final(p):
    return sketch.reduce_cm(p, ["dst_addr"], "size", 2, 16, "final")


@on_packets(
    "a5_reduce_cm_5_rows",
    f"SELECT epoch, dst_addr, estimate FROM {sql.cm_final('packets', ['dst_addr'], 'size', 5, 32)}",
)
def a5_5(p):
    return sketch.reduce_cm(p, ["dst_addr"], "size", 5, 32, "final")


@register(
    "a5_reduce_cm_flows",
    f"WITH {sql.FLOWS} SELECT epoch, src_addr, dst_addr, estimate FROM "
    + sql.cm_final("flows", ["src_addr", "dst_addr"], "size", 3, 1024),
)
def a5_flows(spark, sf_dir):
    return sketch.reduce_cm(flows_from_lineitem(spark, sf_dir), ["src_addr", "dst_addr"], "size", 3, 1024, "final")


@on_packets("a6_heavy_keys_cm", f"SELECT DISTINCT epoch, dst_addr FROM {CM_RUNNING} WHERE estimate >= 8000")
def a6(p):
    return sketch.heavy_keys_cm(p, ["dst_addr"], "size", 2, 16, 8000)


@on_packets("a6_heavy_keys_cm_final", f"SELECT epoch, dst_addr FROM {CM_FINAL} WHERE estimate >= 8000")
def a6_final(p):
    return sketch.heavy_keys_cm(p, ["dst_addr"], "size", 2, 16, 8000, "final")


@on_packets(
    "a7_distinct_count",
    "SELECT epoch, dst_addr, count(DISTINCT src_addr) AS count FROM packets GROUP BY ALL",
)
def a7(p):
    return aggregate.distinct_count(p, ["dst_addr"], ["src_addr"])


@register(
    "a7_distinct_count_merged",
    sql.with_packets(
        "SELECT epoch // 7 AS week, dst_addr, count(DISTINCT src_addr) AS exact, true AS close FROM packets GROUP BY ALL"
    ),
)
def a7_merged(spark, sf_dir):
    """Sketches stored by day, merged by week, against the exact count (within 5 %, three standard errors)."""
    p = packets_from_events(spark, sf_dir)
    path = shared_dir(spark, "sketches")
    aggregate.distinct_sketches(p, ["dst_addr"], ["src_addr"]).write.parquet(path)
    week = F.floor(F.col("epoch") / 7).cast("long").alias("week")
    daily = spark.read.parquet(path).select(week, "dst_addr", "sketch")
    merged = aggregate.merged_distinct_count(daily, ["week", "dst_addr"], "estimate")
    exact = p.groupBy(week, "dst_addr").agg(F.count_distinct("src_addr").alias("exact"))
    close = F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")
    return exact.join(merged, ["week", "dst_addr"]).select("week", "dst_addr", "exact", close.alias("close"))


@register("a8_capture_summary", captures.SUMMARY_SQL)
def a8(spark, sf_dir):
    summary = decode.capture_summary(decode.decode_packets(captures.raw_packets(spark, sf_dir)))
    return summary.na.fill(-1)


# A wire order that differs from time order: neighbours change places.
def swapped(p):
    return p.withColumn(ORDER, F.col(ORDER).bitwiseXOR(F.lit(5).cast("long")))


SWAPPED = "wire AS (SELECT * REPLACE (xor(pkt_no, 5) AS pkt_no) FROM packets)"


@on_packets(
    "a9_skewed_timestamps",
    "SELECT pkt_no, previous_us FROM (SELECT pkt_no, us, lag(us) OVER (ORDER BY pkt_no) AS previous_us FROM wire)"
    " WHERE us < previous_us",
    SWAPPED,
)
def a9(p):
    return decode.skewed_timestamps(swapped(p)).select("pkt_no", "previous_us")


# --- joins ------------------------------------------------------------------------


@on_packets(
    "j1_zip_streams",
    "SELECT epoch, dst_addr, syn, fin FROM sums WHERE syn IS NOT NULL AND fin IS NOT NULL",
    SYN_FIN,
)
def j1(p):
    return zipped(p)


@on_packets(
    "j2_zip_diff", "SELECT epoch, dst_addr, coalesce(syn, 0) - coalesce(fin, 0) AS diff FROM sums", SYN_FIN
)
def j2(p):
    syn, fin = syn_fin(p)
    return joins.zip_diff(syn, fin, "dst_addr", "dst_addr", "syn", "fin")


@register(
    "j2_zip_diff_flows",
    f"WITH {sql.FLOWS} SELECT epoch, dst_addr, CAST(sum(CASE WHEN flag = 'R' THEN size ELSE -size END) AS BIGINT)"
    " AS diff FROM flows WHERE flag IN ('R', 'A') GROUP BY ALL",
)
def j2_flows(spark, sf_dir):
    f = flows_from_lineitem(spark, sf_dir)
    returned, accepted = f.where("flag = 'R'"), f.where("flag = 'A'")
    return joins.zip_diff(returned, accepted, "dst_addr", "dst_addr", "size", "size")


SIGNED_CELLS = sql.cells(
    "(SELECT epoch, dst_addr, v AS p, 0 AS m FROM syn UNION ALL SELECT epoch, dst_addr, 0 AS p, v AS m FROM fin)",
    ["dst_addr"],
    2,
    16,
)


@on_packets(
    "j3_zip_diff_cm",
    f"""SELECT epoch, dst_addr, CAST(min(p) - min(m) AS BIGINT) AS diff
    FROM (SELECT epoch, dst_addr, sum(p) OVER w AS p, sum(m) OVER w AS m FROM {SIGNED_CELLS}
          WINDOW w AS (PARTITION BY epoch, row, cell)) GROUP BY epoch, dst_addr""",
    SYN_FIN,
)
def j3(p):
    syn, fin = syn_fin(p)
    return sketch.zip_diff_cm(syn, fin, "dst_addr", "dst_addr", "syn", "fin", 2, 16)


DDOS_SIZES = [(2, 256), (2, 16)]
DDOS_EST = sql.sketch_report("dst_addr", ["dst_addr", "src_addr"], 7, DDOS_SIZES)
DDOS_EXACT = sql.exact_report("dst_addr", "src_addr", 7)
N_EPOCH = "(SELECT max(epoch) FROM packets)"  # in SQL: all complete days of the table


def ddos_sets(p):
    return detections.ddos_sketch(p, *DDOS_SIZES, 7), detections.ddos(p, 7)


@on_packets(
    "j4_match_baseline",
    f"SELECT epoch, n_est, n_exact, n_correct FROM {sql.metrics(DDOS_EST, DDOS_EXACT, 'dst_addr', 40)}"
    " WHERE n_est + n_exact > 0",
)
def j4(p):
    est, exact = ddos_sets(p)
    return joins.match_baseline(est, exact, ["dst_addr"])


# --- epochs -----------------------------------------------------------------------


@on_packets(
    "w1_with_epoch",
    "SELECT pkt_no, (us - (SELECT min(us) FROM packets)) // 21600000000 AS epoch FROM packets",
)
def w1(p):
    return epochs.with_epoch(p.drop(EPOCH), 21600.0).select("pkt_no", "epoch")


@on_packets(
    "w2_complete_epochs",
    "SELECT epoch, count(*) AS n FROM packets WHERE epoch < least(20, (SELECT max(epoch) FROM packets)) GROUP BY ALL",
)
def w2(p):
    return epochs.complete_epochs(p, 20).groupBy(EPOCH).agg(F.count(F.lit(1)).alias("n"))


@on_packets(
    "w2_all_complete_epochs",
    "SELECT epoch, count(*) AS n FROM packets WHERE epoch < (SELECT max(epoch) FROM packets) GROUP BY ALL",
)
def w2_all(p):
    return epochs.complete_epochs(p).groupBy(EPOCH).agg(F.count(F.lit(1)).alias("n"))


@on_packets(
    "w3_fill_epochs",
    f"SELECT r.epoch, coalesce(n, 0) AS n FROM (SELECT unnest(range({N_EPOCH})) AS epoch) r LEFT JOIN"
    " (SELECT epoch, count(*) AS n FROM packets WHERE dst_addr = 7 AND tcp_flags = 2 GROUP BY ALL) c"
    " ON c.epoch = r.epoch",
)
def w3(p):
    counts = p.where("dst_addr = 7 AND tcp_flags = 2").groupBy(EPOCH).agg(F.count(F.lit(1)).alias("n"))
    return epochs.fill_epochs(p.sparkSession, counts, epochs.n_complete(p), ["n"])


@on_packets(
    "w5_clamp_epoch",
    "SELECT pkt_no, greatest(max(e) OVER (ORDER BY pkt_no), 0) AS epoch FROM (SELECT pkt_no,"
    " CAST(floor((us - (SELECT arg_min(us, pkt_no) FROM wire)) / 3600000000.0) AS BIGINT) AS e FROM wire)",
    SWAPPED,
)
def w5(p):
    hours = epochs.with_epoch(swapped(p).drop(EPOCH), 3600.0)
    return epochs.clamp_epoch(hours).select("pkt_no", "epoch")


# --- registers --------------------------------------------------------------------


@on_packets("u1_map_udf", "SELECT epoch, pkt_no, nkey, cnt_flag FROM hs", sql.HANDSHAKE)
def u1(p):
    return detections.handshake_packets(p).select("epoch", "pkt_no", "nkey", "cnt_flag")


@on_packets(
    "u2_state_add",
    "SELECT epoch, pkt_no, CAST(sum(CASE WHEN tcp_flags = 2 THEN 1 WHEN (tcp_flags & 1) <> 0 THEN -1 ELSE 0 END)"
    f" OVER (PARTITION BY epoch, dst_addr {sql.RUNNING}) AS BIGINT) AS open FROM packets",
)
def u2(p):
    delta = F.when(F.col("tcp_flags") == 2, 1).when(F.col("tcp_flags").bitwiseAND(1) != 0, -1).otherwise(0)
    return state.state_add(p, ["ipv4.dst_addr"], delta, "open").select("epoch", "pkt_no", "open")


def last_seq(p):
    return state.state_last(
        p, ["ipv4.dst_addr"], F.col("tcp_flags") == 18, scalar.add_mod32("tcp.seq", 1), "nextseq"
    )


@on_packets(
    "u3_state_last",
    "SELECT epoch, pkt_no, coalesce(last_value(CASE WHEN tcp_flags = 18 THEN tcp_seq + 1 END IGNORE NULLS)"
    f" OVER (PARTITION BY epoch, dst_addr {sql.RUNNING}), 0) AS nextseq FROM packets",
)
def u3(p):
    return last_seq(p).select("epoch", "pkt_no", "nextseq")


MAX_SEEN = (
    "coalesce(max(size) OVER (PARTITION BY epoch, dst_addr ORDER BY pkt_no"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
)


@on_packets("u4_state_max_seen", f"SELECT epoch, pkt_no, {MAX_SEEN} AS seen FROM packets")
def u4(p):
    seen = state.state_max_seen(p, ["ipv4.dst_addr"], "size", "seen")
    return seen.select("epoch", "pkt_no", F.col("seen").cast("long").alias("seen"))


ERAS = "SELECT *, sum(CAST(tcp_flags = 2 AS INTEGER)) OVER (PARTITION BY epoch, dst_addr {running}) AS era FROM packets".format(running=sql.RUNNING)


@on_packets(
    "u_state_assign_add",
    f"""SELECT epoch, pkt_no, CAST(coalesce(first_value(CASE WHEN tcp_flags = 2 THEN dport END) OVER w, 0)
      + coalesce(sum(CASE WHEN tcp_flags = 16 THEN size END) OVER w, 0) AS BIGINT) AS reg
    FROM ({ERAS}) WINDOW w AS (PARTITION BY epoch, dst_addr, era ORDER BY pkt_no ROWS UNBOUNDED PRECEDING)""",
)
def u_assign_add(p):
    """A register that is both assigned and added to."""
    cases = [(F.col("tcp_flags") == 2, "=", "dport"), (F.col("tcp_flags") == 16, "+=", "size")]
    return state.state_branches(p, ["ipv4.dst_addr"], cases, "reg").select("epoch", "pkt_no", "reg")


@on_packets(
    "u_state_assign_max",
    f"""SELECT epoch, pkt_no, CAST(greatest(CASE WHEN era = 0 THEN 0 ELSE -1 END,
      coalesce(max(CASE WHEN tcp_flags = 2 THEN dport WHEN tcp_flags = 16 THEN size END) OVER w, 0)) AS BIGINT) AS reg
    FROM ({ERAS}) WINDOW w AS (PARTITION BY epoch, dst_addr, era ORDER BY pkt_no ROWS UNBOUNDED PRECEDING)""",
)
def u_assign_max(p):
    """A register that is both assigned and raised."""
    cases = [(F.col("tcp_flags") == 2, "=", "dport"), (F.col("tcp_flags") == 16, "max=", "size")]
    return state.state_branches(p, ["ipv4.dst_addr"], cases, "reg").select("epoch", "pkt_no", "reg")


def largest_and_total(key, packets, before):
    """Two registers at once: the largest size before, and the sum of sizes."""
    largest, total = before
    sizes = packets["size"].astype("int64")
    out = packets[["epoch", "pkt_no"]].copy()
    seen = sizes.cummax().clip(lower=largest)
    out["seen"] = seen.shift(1, fill_value=largest)
    out["total"] = sizes.cumsum() + total
    return out, (int(seen.iloc[-1]), int(out["total"].iloc[-1]))


def largest_and_total_of_many(packets, first, before):
    largest, total = before
    counts = np.diff(np.append(first, len(packets)))
    own, last = np.repeat(np.arange(len(first)), counts), first + counts - 1
    sizes = packets["size"].astype("int64")
    seen = np.maximum(sizes.groupby(own).cummax().to_numpy(), largest[own])
    sums = sizes.groupby(own).cumsum().to_numpy() + total[own]
    earlier = np.concatenate(([0], seen[:-1]))
    earlier[first] = largest
    return packets[["epoch", "pkt_no"]].assign(seen=earlier, total=sums), [seen[last], sums[last]]


FOLD_OUT = T.StructType([T.StructField(n, T.LongType()) for n in ("epoch", "pkt_no", "seen", "total")])
FOLD_STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("largest", "total")])


@on_packets(
    "u5_stateful_fold",
    f"SELECT epoch, pkt_no, {MAX_SEEN} AS seen, CAST({RUN} AS BIGINT) AS total FROM packets",
)
def u5(p):
    narrow = p.select("epoch", "pkt_no", "dst_addr", "size")
    fold = GroupedFold(largest_and_total, largest_and_total_of_many)
    return state.stateful_fold(narrow, ["dst_addr"], fold, (0, 0), FOLD_STATE, FOLD_OUT)


OPEN_CELLS = sql.cells("packets", ["dst_addr"], 2, 32)


@on_packets(
    "u6_state_shared_cells",
    f"""SELECT epoch, pkt_no, min(reg) AS open FROM (
      SELECT epoch, pkt_no, CAST(sum(CASE WHEN tcp_flags = 2 THEN 1 WHEN (tcp_flags & 1) <> 0 THEN -1 ELSE 0 END)
        OVER (PARTITION BY epoch, row, cell {sql.RUNNING}) AS BIGINT) AS reg FROM {OPEN_CELLS})
    GROUP BY epoch, pkt_no""",
)
def u6(p):
    delta = F.when(F.col("tcp_flags") == 2, 1).when(F.col("tcp_flags").bitwiseAND(1) != 0, -1).otherwise(0)

    return sketch.state_shared_cells(p, ["dst_addr"], 2, 32, ("add", delta), "open").select("epoch", "pkt_no", "open")


@on_packets(
    "u6_state_shared_cells_assign",
    f"""SELECT epoch, pkt_no, min(reg) AS nextseq FROM (
      SELECT epoch, pkt_no, coalesce(last_value(CASE WHEN tcp_flags = 18 THEN tcp_seq + 1 END IGNORE NULLS)
        OVER (PARTITION BY epoch, row, cell {sql.RUNNING}), 0) AS reg FROM {OPEN_CELLS})
    GROUP BY epoch, pkt_no""",
)
def u6_assign(p):
    update = ("assign", F.col("tcp_flags") == 18, scalar.add_mod32("tcp.seq", 1))
    return sketch.state_shared_cells(p, ["dst_addr"], 2, 32, update, "nextseq").select("epoch", "pkt_no", "nextseq")


def fingerprint_ctes(src: str, key: str, width: int) -> str:
    """Owners of a two-row fingerprint table, row by row."""
    c0 = sql.cells("fp_keys", [key], 1, width)
    c1 = f"(SELECT * FROM {sql.cells('fp_rest', [key], 2, width)} WHERE row = 1)"
    first = "QUALIFY row_number() OVER (PARTITION BY epoch, cell ORDER BY first_no) = 1"
    return f"""
fp_keys AS (SELECT epoch, {key}, min(pkt_no) AS first_no FROM {src} GROUP BY ALL),
fp_own0 AS (SELECT epoch, {key}, row FROM {c0} {first}),
fp_rest AS (SELECT k.* FROM fp_keys k ANTI JOIN fp_own0 o ON o.epoch = k.epoch AND o.{key} = k.{key}),
fp_own1 AS (SELECT epoch, {key}, row FROM {c1} {first}),
fp_owners AS (SELECT * FROM fp_own0 UNION ALL SELECT * FROM fp_own1)"""


@on_packets(
    "u7_state_fingerprint",
    "SELECT p.epoch, p.pkt_no, p.dst_addr, o.row FROM packets p JOIN fp_owners o"
    " ON o.epoch = p.epoch AND o.dst_addr = p.dst_addr",
    fingerprint_ctes("packets", "dst_addr", 16),
)
def u7(p):
    return sketch.state_fingerprint(p, ["dst_addr"], 2, 16).select("epoch", "pkt_no", "dst_addr", "row")


# --- accuracy and sizing ----------------------------------------------------------

SPEC = AccuracySpec(precision_min=0.3, recall_min=0.9, confidence=0.8)
RANK = sql.rank(N_EPOCH, SPEC.confidence)
METRICS = sql.metrics(DDOS_EST, DDOS_EXACT, "dst_addr", N_EPOCH)


def within(df):
    return epochs.complete_epochs(df)


@on_packets(
    "e1_precision_recall",
    f'SELECT epoch, n_est, n_exact, n_correct, round("precision", 6) AS "precision", round(recall, 6) AS recall'
    f" FROM {METRICS}",
)
def e1(p):
    est, exact = ddos_sets(within(p))
    return accuracy.precision_recall(est, exact, ["dst_addr"], epochs.n_complete(p))


@on_packets(
    "e2_relative_error",
    f"""SELECT r.epoch, round(coalesce(are, 0), 6) AS are
    FROM (SELECT unnest(range({N_EPOCH})) AS epoch) r LEFT JOIN (
      SELECT x.epoch, avg(CASE WHEN e.estimate IS NULL THEN 1 ELSE abs(e.estimate - x.n) / x.n END) AS are
      FROM (SELECT epoch, dst_addr, sum(size) AS n FROM packets GROUP BY ALL) x
      LEFT JOIN (SELECT * FROM {CM_FINAL} WHERE estimate >= 8000) e
        ON e.epoch = x.epoch AND e.dst_addr = x.dst_addr
      GROUP BY x.epoch) a ON a.epoch = r.epoch""",
)
def e2(p):
    n, p = epochs.n_complete(p), within(p)
    exact = aggregate.reduce_sum(p, ["dst_addr"], "size")
    est = sketch.reduce_cm(p, ["dst_addr"], "size", 2, 16, "final", "size")
    return accuracy.relative_error(est.where("size >= 8000"), exact, ["dst_addr"], "size", n)


DIFF_EXACT = "(SELECT epoch, dst_addr, coalesce(syn, 0) - coalesce(fin, 0) AS value FROM sums)"
DIFF_EST = """(SELECT epoch, dst_addr, min(p) - min(m) AS value FROM (
  SELECT epoch, dst_addr, sum(p) OVER (PARTITION BY epoch, row, cell) AS p, sum(m) OVER (PARTITION BY epoch, row, cell) AS m
  FROM {}) GROUP BY ALL)""".format(
    sql.cells(
        "(SELECT epoch, dst_addr, v AS p, 0 AS m FROM syn UNION ALL SELECT epoch, dst_addr, 0 AS p, v AS m FROM fin)",
        ["dst_addr"], 2, 64,
    )
)


@on_packets(
    "e2_relative_error_diff",
    f"SELECT epoch, round(are, 6) AS are FROM {sql.relative_errors(DIFF_EST, DIFF_EXACT, 'dst_addr', N_EPOCH)}",
    SYN_FIN,
)
def e2_diff(p):
    """Differences hold zeros and negative values."""
    syn, fin = syn_fin(within(p))
    exact = joins.zip_diff(syn, fin, "ipv4.dst_addr", "ipv4.dst_addr", "syn", "fin", "value")
    est = sketch.zip_diff_cm(syn, fin, "ipv4.dst_addr", "ipv4.dst_addr", "syn", "fin", 2, 64, "value")
    return accuracy.relative_error(est, exact, ["dst_addr"], "value", epochs.n_complete(p))


GATE = sql.gate(METRICS, RANK, SPEC.precision_min, SPEC.recall_min, N_EPOCH)


@on_packets("e3_confidence_gate", GATE)
def e3(p):
    est, exact = ddos_sets(within(p))
    n = epochs.n_complete(p)
    metrics = accuracy.precision_recall(est, exact, ["dst_addr"], n)
    return accuracy.confidence_gate(metrics, SPEC, n)


PAGE = 16  # small pages, so that keys of the test tables do collide
DDOS = tuning.CountQuery("dst_addr", 7, ("dst_addr", "src_addr"))
DDOS_CONFIG = ((2, 2), (2, 4))
CONFIGS = [((2, 2), (2, 4)), ((1, 8), (1, 8)), ((3, 16), (4, 16)), ((4, 32), (2, 32))]


@on_packets("e4_accuracy_report", GATE)
def e4(p):
    return tuning.accuracy_report(p, DDOS, DDOS_CONFIG, SPEC, page_bytes=PAGE)


def score_sql(config) -> float:
    limits, n = tuning.Limits(), len(config)
    d = sum(x for x, _ in config)
    return (
        f"({limits.alpha} * {d} / {4 * n} + {limits.beta / 2} * {sum(x * w for x, w in config) + d} / {48 * n}"
        f" + {limits.beta / 2} * {sum(w for _, w in config) / n} / 32)"
    )


def configs_sql() -> str:
    parts = []
    for i, config in enumerate(CONFIGS):
        sizes = sql.widths(config, [tuning.BLOOM_BITS, tuning.COUNTER_BITS], PAGE)
        est = sql.sketch_report("dst_addr", ["dst_addr", "src_addr"], 7, sizes)
        gated = sql.gate(
            sql.metrics(est, DDOS_EXACT, "dst_addr", N_EPOCH), RANK, SPEC.precision_min, SPEC.recall_min, N_EPOCH
        )
        parts.append(f"SELECT CAST({i} AS BIGINT) AS conf_id, *, round({score_sql(config)}, 6) AS score FROM ({gated})")
    return " UNION ALL ".join(parts)


@on_packets("e7_evaluate_configs", configs_sql())
def e7(p):
    return tuning.evaluate_configs(p, DDOS, CONFIGS, SPEC, page_bytes=PAGE)


ARE_SPEC = AccuracySpec(0.3, 0.9, 0.8, are_max=0.5)
BYTES = tuning.CountQuery("ipv4.dst_addr", 1500, value="size")
PAIRS = tuning.CountQuery(("src_addr", "dst_addr"), 900, value="size")


def valued_sql(keys: str, n: int, config) -> str:
    """Gate with relative error of a Count-Min over sizes; ``config`` is its (rows, pages)."""
    (d, width), = sql.widths([config], [tuning.COUNTER_BITS], PAGE)
    est = sql.value_report(keys, "size", n, d, width)
    exact = f"(SELECT epoch, {keys}, sum(size) AS value FROM packets GROUP BY ALL HAVING sum(size) >= {n})"
    spec = ARE_SPEC
    return sql.gate_are(
        sql.metrics(est, exact, keys, N_EPOCH), sql.relative_errors(est, exact, keys, N_EPOCH), RANK,
        spec.precision_min, spec.recall_min, spec.are_max, N_EPOCH,
    )


def valued_configs_sql(keys: str, n: int, sizes) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS conf_id, *, round({score_sql([c])}, 6) AS score FROM ({valued_sql(keys, n, c)})"
        for i, c in enumerate(sizes)
    )


VALUED_SIZES = [(2, 4), (1, 32), (5, 16)]


@on_packets("e4_accuracy_report_are", valued_sql("dst_addr", 1500, (2, 16)))
def e4_are(p):
    return tuning.accuracy_report(p, BYTES, ((2, 16),), ARE_SPEC, page_bytes=PAGE)


@on_packets("e7_evaluate_configs_are", valued_configs_sql("dst_addr", 1500, VALUED_SIZES))
def e7_are(p):
    return tuning.evaluate_configs(p, BYTES, [(c,) for c in VALUED_SIZES], ARE_SPEC, page_bytes=PAGE)


@on_packets("e7_evaluate_configs_two_keys", valued_configs_sql("src_addr, dst_addr", 900, VALUED_SIZES))
def e7_pairs(p):
    return tuning.evaluate_configs(p, PAIRS, [(c,) for c in VALUED_SIZES], ARE_SPEC, page_bytes=PAGE)


# The published sizes as (rows, pages) of 16 KiB, in the order of the tables.
PUBLISHED = {
    "newconn": ((2, 4),),
    "ddos": ((2, 8), (2, 8)),
    "portscan": ((1, 32), (2, 16)),
    "superspreader": ((2, 4), (2, 8)),
    "synflood": ((1, 1), (2, 1)),
}
INTENT = AccuracySpec(0.9, 0.9, 0.9)
INTENT_RANK = sql.rank(N_EPOCH, INTENT.confidence)
SYN = "(SELECT * FROM packets WHERE proto = 6 AND tcp_flags = 2)"
COUNTED = {
    # The key, the element counted once, the threshold on the test tables, the packets.
    "newconn": ("dst_addr", None, 3, SYN, tuning.CountQuery("dst_addr", 3, prepare=detections.syn_packets)),
    "ddos": ("dst_addr", "src_addr", 7, "packets", DDOS),
    "portscan": ("src_addr", "dport", 5, "packets", tuning.CountQuery("src_addr", 5, ("src_addr", "dport"))),
    "superspreader": ("src_addr", "dst_addr", 5, "packets", tuning.CountQuery("src_addr", 5, ("src_addr", "dst_addr"))),
}


def published_sql() -> str:
    parts = []
    for name, (key, elem, n, src, _) in COUNTED.items():
        bits = [tuning.BLOOM_BITS, tuning.COUNTER_BITS] if elem else [tuning.COUNTER_BITS]
        est = sql.sketch_report(key, [key, elem] if elem else [], n, sql.widths(PUBLISHED[name], bits, sketch.PAGE_BYTES), src)
        counted = f"count(DISTINCT {elem})" if elem else "count(*)"
        exact = f"(SELECT epoch, {key} FROM {src} GROUP BY epoch, {key} HAVING {counted} >= {n})"
        gated = sql.gate(sql.metrics(est, exact, key, N_EPOCH), INTENT_RANK, 0.9, 0.9, N_EPOCH)
        parts.append(f"SELECT '{name}' AS app, * FROM ({gated})")
    return " UNION ALL ".join(parts)


@on_packets("e4_published_sizes", published_sql())
def e4_published(p):
    reports = [
        tuning.accuracy_report(p, query, PUBLISHED[name], INTENT).select(F.lit(name).alias("app"), "*")
        for name, (*_, query) in COUNTED.items()
    ]
    return reduce(DataFrame.unionByName, reports)


@register(
    "a5_published_flows",
    f"WITH {sql.FLOWS} SELECT epoch, dst_addr, estimate FROM " + sql.cm_final("flows", ["dst_addr"], "size", 2, 16384),
)
def a5_published(spark, sf_dir):
    """The published Count-Min of the new-connection query over the larger flow table."""
    (d, pages), = PUBLISHED["newconn"]
    width = sketch.cells_per_row(pages, tuning.COUNTER_BITS)
    return sketch.reduce_cm(flows_from_lineitem(spark, sf_dir), ["dst_addr"], "size", d, width, "final")


# Sizes taken from the data: rows by the packets of an epoch, pages by its distinct keys.
def sized_by_epoch(p):
    per_epoch = p.groupBy(EPOCH).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("src_addr").alias("sources"),
        F.count_distinct("dst_addr").alias("hosts"),
    )
    d = (F.col("n") % 5).cast("int")
    sizes = F.explode(
        F.array(
            F.struct(F.lit("distinct").alias("table"), d.alias("d"), (F.col("sources") % 20).cast("int").alias("w")),
            F.struct(F.lit("count").alias("table"), F.lit(2).alias("d"), (F.col("hosts") % 25).cast("int").alias("w")),
        )
    )
    return per_epoch.select(F.col(EPOCH).alias("conf_id"), sizes.alias("s")).select("conf_id", "s.*")


SIZED = """
sized AS (
  SELECT epoch AS conf_id, CAST(count(*) % 5 AS BIGINT) AS d, count(DISTINCT src_addr) % 20 AS w FROM packets GROUP BY ALL
  UNION ALL
  SELECT epoch AS conf_id, CAST(2 AS BIGINT) AS d, count(DISTINCT dst_addr) % 25 AS w FROM packets GROUP BY ALL)"""


@on_packets(
    "e5_resource_score",
    "SELECT conf_id, round(1000 * (0.4 * sum(d) / (4 * count(*)) + 0.3 * (sum(d * w) + sum(d)) / (48 * count(*))"
    " + 0.3 * avg(w) / 32), 6) AS milli_score FROM sized GROUP BY conf_id",
    SIZED,
)
def e5(p):
    scored = tuning.resource_score(sized_by_epoch(p))
    return scored.select("conf_id", (F.col("score") * 1000).alias("milli_score"))


@on_packets(
    "e6_valid_conf",
    "SELECT conf_id FROM sized GROUP BY conf_id HAVING"
    " bool_and(d BETWEEN 1 AND 4 AND w BETWEEN 1 AND 48 AND d * (w + 1) <= 48)",
    SIZED,
)
def e6(p):
    return tuning.valid_conf(sized_by_epoch(p))


@on_packets(
    "u5_stateful_fold_handshakes",
    f"""SELECT epoch, pkt_no, nkey, nextseq, CAST(sum({sql.DELTA}) OVER (PARTITION BY epoch, nkey {sql.RUNNING}) AS BIGINT)
      AS cnt FROM (SELECT * REPLACE (CASE WHEN nextseq = tcp_ack THEN 2 ELSE cnt_flag END AS cnt_flag) FROM (
      SELECT *, coalesce(last_value(CASE WHEN tcp_flags = 18 THEN tcp_seq + 1 END IGNORE NULLS)
        OVER (PARTITION BY epoch, nkey {sql.RUNNING}), 0) AS nextseq FROM hs))""",
    sql.HANDSHAKE,
)
def u5_handshakes(p):
    hs = detections.handshake_packets(p)
    return state.stateful_fold(
        hs,
        ["nkey"],
        stream_detections.handshake_fold,
        (0, 0),
        stream_detections.HANDSHAKE_STATE,
        stream_detections.HANDSHAKE_OUT,
    )


TUNED, TUNED_PAGE = tuning.Limits(alu_max=2, page_max=4), 1024
TUNE_SPEC = AccuracySpec(0.8, 0.8, 0.8)
# Hosts with twice the usual number of sources: at any scale some sizes are too small to tell them.
BUSY = """(SELECT CAST(ceil(2 * avg(c)) AS BIGINT) FROM (SELECT count(DISTINCT src_addr) AS c FROM packets GROUP BY epoch, dst_addr))"""


def busy_hosts(p):
    usual = p.groupBy(EPOCH, "dst_addr").agg(F.count_distinct("src_addr").alias("c")).agg(F.ceil(2 * F.avg("c"))).first()[0]
    return tuning.CountQuery("dst_addr", usual, ("dst_addr", "src_addr"))


def judged_sql(where: str) -> str:
    """Every size within the limits (d0, w0, d1, w1), judged on the packets of ``where``."""
    n_epoch = f"(SELECT max(epoch) FROM {where})"
    rank = sql.rank(n_epoch, TUNE_SPEC.confidence)
    pairs = [(d, w) for d in (1, 2) for w in (1, 2, 4)]
    exact = f"(SELECT epoch, dst_addr FROM {where} GROUP BY epoch, dst_addr HAVING count(DISTINCT src_addr) >= {BUSY})"
    parts = []
    for first in pairs:
        for second in pairs:
            sizes = sql.widths((first, second), [tuning.BLOOM_BITS, tuning.COUNTER_BITS], TUNED_PAGE)
            est = sql.sketch_report("dst_addr", ["dst_addr", "src_addr"], BUSY, sizes, where)
            gated = sql.gate(sql.metrics(est, exact, "dst_addr", n_epoch), rank, 0.8, 0.8, n_epoch)
            parts.append(
                f"SELECT *, {first[0]} AS d0, {first[1]} AS w0, {second[0]} AS d1, {second[1]} AS w1,"
                f" {score_sql((first, second))} AS score FROM ({gated})"
            )
    return f"({' UNION ALL '.join(parts)})"


def tuned_sql(where: str) -> str:
    """The cheapest size that passes, or else the one largest size, as one row."""
    return (
        f"(SELECT * FROM {judged_sql(where)} ORDER BY success DESC, CASE WHEN success THEN score END,"
        " CASE WHEN success THEN 1 ELSE -1 END * (d0 * 1000 + w0 * 100 + d1 * 10 + w1) LIMIT 1)"
    )


@on_packets(
    "e8_tune_sketch",
    "SELECT CAST(0 AS BIGINT) AS conf_id, t.name AS \"table\", CAST(CASE t.name WHEN 'distinct' THEN d0 ELSE d1 END AS BIGINT) AS d,"
    " CAST(CASE t.name WHEN 'distinct' THEN w0 ELSE w1 END AS BIGINT) AS w, round(score, 6) AS score, success"
    f" FROM {tuned_sql('packets')}, (VALUES ('distinct'), ('count')) t(name)",
)
def e8(p):
    return tuning.tune_sketch(p, busy_hosts(p), TUNE_SPEC, limits=TUNED, page_bytes=TUNED_PAGE)


def days(p, odd: int):
    return p.where(F.col(EPOCH) % 2 == odd).withColumn(EPOCH, F.floor(F.col(EPOCH) / 2))


def days_sql(odd: int) -> str:
    return f"(SELECT * REPLACE (epoch // 2 AS epoch) FROM packets WHERE epoch % 2 = {odd})"


@on_packets(
    "e8_verify_held_out",
    "SELECT r.* EXCLUDE (d0, w0, d1, w1, score), 'distinct:' || d0 || 'x' || w0 || ',count:' || d1 || 'x' || w1 AS config, t.success AS tuned"
    f" FROM {judged_sql(days_sql(1))} r JOIN (SELECT d0, w0, d1, w1, success FROM {tuned_sql(days_sql(0))}) t USING (d0, w0, d1, w1)",
)
def e8_held_out(p):
    """Sizes tuned on the even days, reported on the odd ones."""
    return tuning.verify_held_out(days(p, 0), days(p, 1), busy_hosts(p), TUNE_SPEC, limits=TUNED, page_bytes=TUNED_PAGE)


# --- functions --------------------------------------------------------------------


@on_packets(
    "f1_arithmetic",
    "SELECT pkt_no, size + dport AS a, tcp_seq - tcp_ack AS b, -size AS c FROM packets",
)
def f1(p):
    return p.select(
        "pkt_no",
        (F.col("size") + F.col("dport")).alias("a"),
        (F.col("tcp_seq") - F.col("tcp_ack")).alias("b"),
        (-F.col("size")).alias("c"),
    )


@on_packets(
    "f2_comparisons",
    "SELECT pkt_no, tcp_seq = tcp_ack AS eq, tcp_seq <> tcp_ack AS ne, tcp_seq < tcp_ack AS lt, tcp_seq <= tcp_ack AS le,"
    " tcp_seq > tcp_ack AS gt, tcp_seq >= tcp_ack AS ge, (tcp_seq & tcp_ack) <> 0 AS bit_and FROM packets",
)
def f2(p):
    return p.select("pkt_no", *[scalar.compare("tcp.seq", op, "tcp.ack").alias(op) for op in scalar.COMPARISONS])


@on_packets(
    "f3_branches",
    "SELECT pkt_no, CASE WHEN tcp_flags = 2 THEN 1 WHEN tcp_flags = 18 THEN dport ELSE tcp_seq END AS v FROM packets",
)
def f3(p):
    cases = [(F.col("tcp_flags") == 2, F.lit(1).cast("long")), (F.col("tcp_flags") == 18, F.col("dport").cast("long"))]
    return p.select("pkt_no", scalar.branch(cases, "tcp.seq").alias("v"))


@on_packets(
    "f5_ipv4_text",
    "SELECT pkt_no, a AS addr, concat_ws('.', a >> 24, (a >> 16) & 255, (a >> 8) & 255, a & 255) AS dotted"
    " FROM (SELECT pkt_no, (src_addr * 2654435761 + dst_addr) % 4294967296 AS a FROM packets)",
)
def f5(p):
    addr = (F.col("src_addr") * 2654435761 + F.col("dst_addr")) % 4294967296
    texts = p.select("pkt_no", scalar.ipv4_text(addr).alias("dotted"))
    return texts.select("pkt_no", scalar.ipv4_number("dotted").alias("addr"), "dotted")


@on_packets("f6_nanoseconds", "SELECT pkt_no, CAST(us / 1e6 * 1e9 AS BIGINT) AS ns FROM packets")
def f6(p):
    return p.select("pkt_no", scalar.nanoseconds("pkt_ts").alias("ns"))


@register("f7_big_endian", captures.BIG_ENDIAN_SQL)
def f7(spark, sf_dir):
    raw = captures.raw_packets(spark, sf_dir)
    return raw.select(
        "pkt_no",
        scalar.big_endian("data", 12, 4).alias("src_addr"),
        scalar.big_endian("data", 2, 2).alias("size"),
        scalar.big_endian("data", 9, 1).alias("proto"),
    )


@register("f8_ip_checksum", captures.CHECKSUM_SQL)
def f8(spark, sf_dir):
    raw = captures.raw_packets(spark, sf_dir)
    return raw.select("pkt_no", scalar.ip_checksum("data", 0, 20).alias("checksum"))


@on_packets(
    "f9_row_cells",
    f"SELECT pkt_no, row, cell FROM {sql.cells('packets', ['dst_addr', 'src_addr', 'dport'], 4, 1000)}",
)
def f9(p):
    return explode_cells(p, ["dst_addr", "src_addr", "dport"], 4, 1000).select("pkt_no", "row", "cell")


@on_packets(
    "f10_add_mod32",
    "SELECT pkt_no, (4294967290 + tcp_seq + 3) % 4294967296 AS v FROM packets",
)
def f10(p):
    return p.select("pkt_no", scalar.add_mod32(F.col("tcp_seq") + 4294967290, 3).alias("v"))


# --- order ------------------------------------------------------------------------


@on_packets("l1_order_packets", "SELECT size, src_addr, dst_addr, sport, dport, proto FROM packets")
def l1(p):
    return basic.order_packets(p.select("size", "src_addr", "dst_addr", "sport", "dport", "proto"))


# --- sources and sinks ------------------------------------------------------------

TRACE_COLUMNS = (
    "pkt_no, us, src_addr, dst_addr, sport, dport, proto, size, tcp_seq, tcp_ack, tcp_flags, 20 AS ip_hdr_size,"
    " tcp_hdr_size"
)


def flat(df):
    """Packet columns with the time as microseconds."""
    return df.withColumn("us", F.unix_micros("ts")).drop("ts", "pkt_ts", "file", "caplen", "len", "status", "epoch")


@on_packets("s1_read_trace", f"SELECT {TRACE_COLUMNS} FROM packets")
def s1(p):
    path = shared_dir(p.sparkSession, "trace")
    trace.write_trace(p, path)
    return flat(trace.read_trace(p.sparkSession, path))


@register("s2_read_pcap", captures.RAW_SQL)
def s2(spark, sf_dir):
    path = shared_dir(spark, "capture")
    captures.write_captures(captures.raw_packets(spark, sf_dir), path)
    read = pcap.read_pcap(spark, path)
    return read.select("pkt_no", F.unix_micros("ts").alias("us"), "caplen", "len", F.hex("data").alias("bytes"))


@register("s3_decode_packets", captures.DECODE_SQL)
def s3(spark, sf_dir):
    return flat_with_status(decode.decode_packets(captures.raw_packets(spark, sf_dir)))


def flat_with_status(df):
    return df.select(
        "pkt_no", "status", "src_addr", "dst_addr", "sport", "dport", "proto", "size", "tcp_seq", "tcp_ack",
        "tcp_flags", "ip_hdr_size", "tcp_hdr_size",
    ).na.fill(-1)


@register("s4_write_valid", captures.VALID_SQL)
def s4(spark, sf_dir):
    path = shared_dir(spark, "valid")
    decoded = decode.decode_packets(captures.raw_packets(spark, sf_dir))
    decode.write_valid(epochs.with_epoch(decoded, 86400.0), path)
    return spark.read.parquet(path).select("pkt_no", F.col("epoch").cast("long").alias("epoch"), "dst_addr", "tcp_flags")


@register("s4_write_valid_stream", captures.VALID_SQL)
def s4_stream(spark, sf_dir):
    stream, start_us = packet_stream(spark, sf_dir)
    path = shared_dir(spark, "valid")
    decoded = decode.decode_packets(captures.as_captured(stream))
    numbered = windows.numbered_epoch(decoded, DAY_SECONDS, NO_DELAY, start_us)
    decode.write_valid_stream(numbered, path, shared_dir(spark, "valid-progress"), available_now=True).awaitTermination()
    return spark.read.parquet(path).select("pkt_no", F.col("epoch").cast("long").alias("epoch"), "dst_addr", "tcp_flags")


@on_packets("s5_flow_text", "SELECT src_addr, sport, dst_addr, dport, proto, size FROM packets")
def s5(p):
    path = shared_dir(p.sparkSession, "flowtext")
    flowtext.format_flow_text(p).write.text(path)
    return flowtext.parse_flow_text(p.sparkSession.read.text(path)).drop("raw")


@on_packets("s6_report", "SELECT DISTINCT epoch, dst_addr FROM packets WHERE tcp_flags = 2")
def s6(p):
    return basic.report(p.where("tcp_flags = 2"), ["ipv4.dst_addr"])


@on_packets(
    "s7_alert_packets",
    f"SELECT {TRACE_COLUMNS} FROM (SELECT * FROM packets WHERE proto = 6 AND tcp_flags = 2"
    " QUALIFY row_number() OVER (PARTITION BY epoch, dst_addr ORDER BY pkt_no) = 3)",
)
def s7(p):
    return flat(detections.alert_packets(detections.syn_packets(p), ["ipv4.dst_addr"], 3))


@on_packets("s8_sketch_conf", f"SELECT epoch, dst_addr, estimate FROM {CM_FINAL}")
def s8(p):
    spark = p.sparkSession
    path = shared_dir(spark, "conf")
    sketch_config.write_sketch_conf(
        spark, spark.createDataFrame([("reduce_table", 2, 4)], "table string, d int, w int"), path
    )
    d, w = sketch_config.sketch_sizes(sketch_config.read_sketch_conf(spark, path))["reduce_table"]
    width = sketch.cells_per_row(w, 32, PAGE)
    return sketch.reduce_cm(p, ["dst_addr"], "size", d, width, "final")


# --- detections -------------------------------------------------------------------

NEWCONN_SQL = (
    "SELECT epoch, dst_addr FROM packets WHERE proto = 6 AND tcp_flags = 2"
    " GROUP BY epoch, dst_addr HAVING count(*) >= 3"
)


def newconn(p):
    return detections.newconn(p, 3)


on_packets("q1_newconn", NEWCONN_SQL)(newconn)
on_packets("q2_ddos", f"SELECT * FROM {DDOS_EXACT}")(lambda p: detections.ddos(p, 7))
on_packets("q3_portscan", f"SELECT * FROM {sql.exact_report('src_addr', 'dport', 5)}")(
    lambda p: detections.portscan(p, 5)
)
on_packets("q4_superspreader", f"SELECT * FROM {sql.exact_report('src_addr', 'dst_addr', 5)}")(
    lambda p: detections.superspreader(p, 5)
)

SYNFLOOD = f"""
SELECT DISTINCT epoch, nkey FROM (
  SELECT *, sum({sql.DELTA}) OVER (PARTITION BY epoch, nkey {sql.RUNNING}) AS cnt FROM (
    SELECT * REPLACE (CASE WHEN nextseq = tcp_ack THEN 2 ELSE cnt_flag END AS cnt_flag) FROM (
      SELECT *, coalesce(last_value(CASE WHEN tcp_flags = 18 THEN tcp_seq + 1 END IGNORE NULLS)
        OVER (PARTITION BY epoch, nkey {sql.RUNNING}), 0) AS nextseq FROM {{src}})))
WHERE cnt > 2"""

on_packets("q5_synflood", SYNFLOOD.format(src="hs"), sql.HANDSHAKE)(lambda p: detections.synflood(p, 2))

NONMONOTONIC = (
    "SELECT epoch, src_addr, dst_addr, sport, dport, CAST(sum(CASE WHEN tcp_seq <= seen THEN 1 ELSE 0 END) AS BIGINT)"
    " AS count FROM (SELECT *, coalesce(max(tcp_seq) OVER (PARTITION BY epoch, src_addr, dst_addr, sport, dport"
    " ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM packets WHERE proto = 6)"
    " GROUP BY epoch, src_addr, dst_addr, sport, dport"
)

on_packets("q6_tcp_nonmonotonic", NONMONOTONIC)(detections.tcp_nonmonotonic)


@on_packets("u5_stateful_fold_on_close", NONMONOTONIC)
def u5_on_close(p):
    """Non-monotonic TCP through the general fold, one row per flow when its epoch is over."""
    tcp = basic.filter_cmp(p, "ipv4.protocol", "eq", "IP_PROTOCOLS_TCP")
    flows = tcp.select(EPOCH, ORDER, *[F.col(k).cast("long").alias(k) for k in detections.FLOW], "tcp_seq")
    return state.stateful_fold(
        flows,
        detections.FLOW,
        stream_detections.flow_fold,
        (0, 0),
        stream_detections.FLOW_STATE,
        stream_detections.FLOW_OUT,
        rows=2,
        on_close=stream_detections.flow_count,
    )


on_packets(
    "q7_incomplete_flows",
    "SELECT epoch, dst_addr FROM sums WHERE coalesce(syn, 0) - coalesce(fin, 0) > 1",
    SYN_FIN,
)(lambda p: detections.incomplete_flows(p, 1))

on_packets(
    "q1c_newconn_cm",
    "SELECT * FROM "
    + sql.sketch_report("dst_addr", [], 3, [(2, 16)], "(SELECT * FROM packets WHERE proto = 6 AND tcp_flags = 2)"),
)(lambda p: detections.newconn_cm(p, 2, 16, 3))
on_packets("q2c_ddos_sketch", f"SELECT * FROM {DDOS_EST}")(lambda p: detections.ddos_sketch(p, *DDOS_SIZES, 7))
on_packets(
    "q3c_portscan_sketch",
    f"SELECT * FROM {sql.sketch_report('src_addr', ['dport', 'src_addr'], 5, [(2, 512), (2, 64)])}",
)(lambda p: detections.portscan_sketch(p, (2, 512), (2, 64), 5))
on_packets(
    "q4c_superspreader_sketch",
    f"SELECT * FROM {sql.sketch_report('src_addr', ['dst_addr', 'src_addr'], 5, [(2, 512), (2, 64)])}",
)(lambda p: detections.superspreader_sketch(p, (2, 512), (2, 64), 5))



def marked_cells(name: str, d: int, width: int) -> str:
    """Handshake packets with ``cnt_flag`` as the shared ``nextseq`` cells make it."""
    return f"""
{name} AS (
  SELECT h.* REPLACE (CASE WHEN n.nextseq = h.tcp_ack THEN 2 ELSE h.cnt_flag END AS cnt_flag)
  FROM hs h JOIN (
    SELECT pkt_no, min(reg) AS nextseq FROM (
      SELECT pkt_no, coalesce(last_value(CASE WHEN tcp_flags = 18 THEN tcp_seq + 1 END IGNORE NULLS)
        OVER (PARTITION BY epoch, row, cell {sql.RUNNING}), 0) AS reg FROM {sql.cells('hs', ['nkey'], d, width)})
    GROUP BY pkt_no) n ON n.pkt_no = h.pkt_no)"""


def flooded_cells(marked: str, d: int, width: int, n: int) -> str:
    return f"""(SELECT DISTINCT epoch, nkey FROM (SELECT epoch, pkt_no, nkey, min(reg) AS cnt FROM (
      SELECT epoch, pkt_no, nkey, sum({sql.DELTA}) OVER (PARTITION BY epoch, row, cell {sql.RUNNING}) AS reg
      FROM {sql.cells(marked, ['nkey'], d, width)}) GROUP BY ALL) WHERE cnt > {n})"""


on_packets(
    "q5c_synflood_cells",
    f"SELECT * FROM {flooded_cells('marked', 2, 64, 2)}",
    sql.HANDSHAKE,
    marked_cells("marked", 2, 32),
)(lambda p: detections.synflood_cells(p, (2, 32), (2, 64), 2))

FLOOD_CONFIGS = [((1, 8), (2, 16)), ((2, 16), (1, 32))]
FLOOD_SPEC = AccuracySpec(0.5, 0.5, 0.8)


def flood_configs_sql() -> str:
    parts = []
    for i, config in enumerate(FLOOD_CONFIGS):
        d, width = sql.widths(config, [tuning.COUNTER_BITS] * 2, PAGE)[1]
        est = flooded_cells(f"marked{i}", d, width, 2)
        rank = sql.rank(N_EPOCH, FLOOD_SPEC.confidence)
        gated = sql.gate(sql.metrics(est, f"({SYNFLOOD.format(src='hs')})", "nkey", N_EPOCH), rank, 0.5, 0.5, N_EPOCH)
        parts.append(f"SELECT CAST({i} AS BIGINT) AS conf_id, *, round({score_sql(config)}, 6) AS score FROM ({gated})")
    return " UNION ALL ".join(parts)


@on_packets(
    "e7_evaluate_register_configs",
    flood_configs_sql(),
    sql.HANDSHAKE,
    *[
        marked_cells(f"marked{i}", *sql.widths(c, [tuning.COUNTER_BITS] * 2, PAGE)[0])
        for i, c in enumerate(FLOOD_CONFIGS)
    ],
)
def e7_registers(p):
    return tuning.evaluate_configs(p, tuning.SynFloodQuery(2), FLOOD_CONFIGS, FLOOD_SPEC, page_bytes=PAGE)


on_packets(
    "q5f_synflood_fingerprint",
    SYNFLOOD.format(src="(SELECT h.* FROM hs h JOIN fp_owners o ON o.epoch = h.epoch AND o.nkey = h.nkey)"),
    sql.HANDSHAKE,
    fingerprint_ctes("hs", "nkey", 16),
)(lambda p: detections.synflood_fingerprint(p, 2, 16, 2))


# --- streams: the batch answer for every closed epoch -----------------------------


def on_stream(name: str, body: str, *ctes: str):
    """Register a streaming query; ``fn`` gets the packet stream and its first time."""

    def keep(fn):
        def run(spark, sf_dir):
            stream, start_us = packet_stream(spark, sf_dir)
            return windows.run_to_end(fn(stream, start_us), name)

        closed = f"SELECT * FROM ({body}) WHERE epoch < (SELECT max(epoch) FROM packets)"
        register(name, sql.with_packets(closed, *ctes))(run)
        return fn

    return keep


@on_stream(
    "w4_with_window_stream",
    "SELECT epoch, dst_addr, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM packets GROUP BY ALL",
)
def w4(stream, start_us):
    w = windows.with_window(stream, DAY_SECONDS, NO_DELAY, start_us=start_us)
    sums = w.groupBy("window", "dst_addr").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("size"))
    return sums.select(windows.window_epoch(DAY_SECONDS, start_us), "dst_addr", "n", "size")


@on_stream(
    "d1_distinct_first_stream",
    "SELECT epoch, dst_addr, count(DISTINCT src_addr) AS n FROM packets GROUP BY ALL",
)
def d1_stream(stream, start_us):
    w = windows.with_window(stream, DAY_SECONDS, NO_DELAY, start_us=start_us)
    first = w.dropDuplicates(["window", "dst_addr", "src_addr"])
    counts = first.groupBy("window", "dst_addr").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(windows.window_epoch(DAY_SECONDS, start_us), "dst_addr", "n")


@on_stream(
    "j1_zip_streams_stream",
    "SELECT epoch, dst_addr, syn, fin FROM sums WHERE syn IS NOT NULL AND fin IS NOT NULL",
    SYN_FIN,
)
def j1_stream(stream, start_us):
    w = windows.with_window(stream, DAY_SECONDS, NO_DELAY, start_us=start_us)
    syn = detections.syn_packets(w).select("window", "dst_addr", F.lit(1).alias("syn"))
    fin = detections.flag_counts(w, "TCP_FLAG_FIN", "fin", "window")
    both = joins.zip_streams(
        aggregate.reduce_sum(syn, ["dst_addr"], "syn", "window"),
        aggregate.reduce_sum(fin, ["dst_addr"], "fin", "window"),
        "dst_addr",
        "dst_addr",
        by="window",
    )
    return both.select(windows.window_epoch(DAY_SECONDS, start_us), "dst_addr", "syn", "fin")


on_stream("q1_newconn_stream", NEWCONN_SQL)(lambda s, t: stream_detections.newconn(s, 3, DAY_SECONDS, t, watermark=NO_DELAY))
on_stream("q2_ddos_stream", f"SELECT * FROM {DDOS_EXACT}")(lambda s, t: stream_detections.ddos(s, 7, DAY_SECONDS, t, watermark=NO_DELAY))
on_stream("q3_portscan_stream", f"SELECT * FROM {sql.exact_report('src_addr', 'dport', 5)}")(
    lambda s, t: stream_detections.portscan(s, 5, DAY_SECONDS, t, watermark=NO_DELAY)
)
on_stream("q4_superspreader_stream", f"SELECT * FROM {sql.exact_report('src_addr', 'dst_addr', 5)}")(
    lambda s, t: stream_detections.superspreader(s, 5, DAY_SECONDS, t, watermark=NO_DELAY)
)
on_stream(
    "q7_incomplete_flows_stream",
    "SELECT epoch, dst_addr FROM sums WHERE coalesce(syn, 0) - coalesce(fin, 0) > 1",
    SYN_FIN,
)(lambda s, t: stream_detections.incomplete_flows(s, 1, DAY_SECONDS, t, watermark=NO_DELAY))


def synflood_stream(spark, sf_dir):
    stream, start_us = packet_stream(spark, sf_dir)
    alerts = windows.run_to_end(stream_detections.synflood_alerts(stream, 2, DAY_SECONDS, start_us, watermark=NO_DELAY), "q5_stream")
    return alerts.select("epoch", "nkey").distinct()


# Alerts come with the packets, so the open epoch has them as well.
register("q5_synflood_stream", ORACLES["q5_synflood"])(synflood_stream)

on_stream("q6_tcp_nonmonotonic_stream", NONMONOTONIC)(
    lambda s, t: stream_detections.tcp_nonmonotonic(s, DAY_SECONDS, t, watermark=NO_DELAY)
)


# Alerts come with the packets, so the open epoch has them as well.
@register(
    "s7_alert_packets_stream",
    sql.with_packets(
        f"SELECT epoch, {TRACE_COLUMNS} FROM (SELECT * FROM packets WHERE proto = 6 AND tcp_flags = 2"
        " QUALIFY row_number() OVER (PARTITION BY epoch, dst_addr ORDER BY pkt_no) = 3)"
    ),
)
def s7_stream(spark, sf_dir):
    stream, start_us = packet_stream(spark, sf_dir)
    syn = detections.syn_packets(stream)
    alerts = stream_detections.alert_packets(syn, ["ipv4.dst_addr"], 3, DAY_SECONDS, start_us, watermark=NO_DELAY)
    found = windows.run_to_end(alerts, "s7_stream")
    return flat(found.withColumn("_epoch", F.col("epoch"))).withColumnRenamed("_epoch", "epoch")


@register("a8_capture_summary_stream", captures.SUMMARY_SQL)
def a8_stream(spark, sf_dir):
    stream, _ = packet_stream(spark, sf_dir)
    counts = decode.status_counts(decode.decode_packets(captures.as_captured(stream)))
    return decode.summary_of_counts(windows.run_to_end_complete(counts, "a8_stream")).na.fill(-1)


REPORT_SECONDS = 600


@register(
    "s6_report_stream",
    sql.with_packets(
        "SELECT spine.epoch, hosts.dst_addr FROM (SELECT unnest(range((SELECT max(slot) + 1 FROM slots"
        " WHERE slot < (SELECT max(slot) FROM slots)))) AS epoch) spine LEFT JOIN (SELECT slot, dst_addr FROM slots"
        " WHERE proto = 6 AND tcp_flags = 2 GROUP BY ALL HAVING count(*) >= 2) hosts ON hosts.slot = spine.epoch",
        f"slots AS (SELECT *, (us - (SELECT min(us) FROM packets)) // {REPORT_SECONDS * 1_000_000} AS slot FROM packets)",
    ),
)
def s6_stream(spark, sf_dir):
    stream, start_us = packet_stream(spark, sf_dir)
    path = shared_dir(spark, "report")
    query = stream_report.report_stream(
        stream,
        lambda p: detections.newconn(p, 2, by=windows.WINDOW),
        ["dst_addr"],
        path,
        shared_dir(spark, "report-progress"),
        REPORT_SECONDS,
        start_us,
        watermark=NO_DELAY,
        available_now=True,
    )
    query.awaitTermination()
    return stream_report.read_found(spark, path, T.StructType([T.StructField("dst_addr", T.LongType())]))
