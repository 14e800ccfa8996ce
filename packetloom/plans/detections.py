"""The detection queries, exact and from sketches.

Each takes packets with an epoch column and returns the reported keys per epoch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from packetloom.functions.hashing import with_row_hashes
from packetloom.functions.scalar import add_mod32
from packetloom.operators.aggregate import reduce_sum, threshold
from packetloom.operators.basic import filter_cmp, map_cols, report
from packetloom.operators.distinct import distinct_keys
from packetloom.operators.joins import zip_diff
from packetloom.operators.running import SEGMENT_ROWS, running_last, running_sum, split_hot
from packetloom.operators.sketch import (
    bloom_distinct,
    cells_add,
    cells_assign,
    running_cells,
    heavy_keys_cm,
    state_fingerprint,
)
from packetloom.operators.state import map_udf, state_add, state_last, state_max_seen
from packetloom.schema import CONSTANTS, EPOCH, ORDER, column_names

FLOW = ["src_addr", "dst_addr", "sport", "dport"]


def syn_packets(packets: DataFrame) -> DataFrame:
    """TCP packets whose flag byte is exactly SYN."""
    tcp = filter_cmp(packets, "ipv4.protocol", "eq", "IP_PROTOCOLS_TCP")
    return filter_cmp(tcp, "tcp.flags", "eq", "TCP_FLAG_SYN")


def newconn(packets: DataFrame, n: int = 50, by: str = EPOCH) -> DataFrame:
    """Hosts that receive many new TCP connections."""
    ones = map_cols(syn_packets(packets), ["ipv4.dst_addr", "count"], {"count": 1})
    counts = reduce_sum(ones, ["ipv4.dst_addr"], "count", by)
    return threshold(counts, "count", "ge", n).select(by, "dst_addr")


def _many_distinct(packets: DataFrame, key: str, elem: str, n: int, by: str) -> DataFrame:
    pairs = distinct_keys(packets, [key, elem], by)
    counts = reduce_sum(map_cols(pairs, [key], {"count": 1}), [key], "count", by)
    return threshold(counts, "count", "ge", n).select(by, key)


def ddos(packets: DataFrame, n: int = 180, by: str = EPOCH) -> DataFrame:
    """Hosts reached from many distinct sources."""
    return _many_distinct(packets, "dst_addr", "src_addr", n, by)


def portscan(packets: DataFrame, n: int = 35, by: str = EPOCH) -> DataFrame:
    """Sources that touch many distinct destination ports."""
    return _many_distinct(packets, "src_addr", "dport", n, by)


def superspreader(packets: DataFrame, n: int = 200, by: str = EPOCH) -> DataFrame:
    """Sources that reach many distinct hosts."""
    return _many_distinct(packets, "src_addr", "dst_addr", n, by)


def handshake_packets(
    packets: DataFrame, by: str = EPOCH, order: str = ORDER, carry: Sequence[str] = ()
) -> DataFrame:
    """TCP packets with ACK set, keyed by the server (``nkey``) of their handshake."""
    tcp = filter_cmp(packets, "ipv4.protocol", "eq", "IP_PROTOCOLS_TCP")
    acks = filter_cmp(tcp, "tcp.flags", "bit_and", "TCP_FLAG_ACK")
    syn_ack = F.col("tcp_flags") == CONSTANTS["TCP_FLAG_SYN_ACK"]
    keyed = map_udf(
        acks,
        {
            "nkey": F.when(syn_ack, F.col("src_addr")).otherwise(F.col("dst_addr")),
            "cnt_flag": F.when(syn_ack, F.lit(1)).otherwise(F.lit(0)),
        },
    )
    return keyed.select(by, order, *carry, "nkey", "cnt_flag", "tcp_flags", "tcp_seq", "tcp_ack")


def _is_syn_ack():
    return F.col("tcp_flags") == CONSTANTS["TCP_FLAG_SYN_ACK"]


def _mark_answered(df: DataFrame) -> DataFrame:
    return map_udf(df, {"cnt_flag": [(F.col("nextseq") == F.col("tcp_ack"), 2)]})


def _open_delta():
    return F.when(F.col("cnt_flag") == 1, 1).when(F.col("cnt_flag") == 2, -1).otherwise(0)


def synflood_counts(
    packets: DataFrame, by: str = EPOCH, order: str = ORDER, rows: int | None = SEGMENT_ROWS
) -> DataFrame:
    """Handshake packets with ``cnt``, the half-open handshakes of their server so far."""
    return _open_handshakes(handshake_packets(packets, by, order), by, order, rows)


def _open_handshakes(hs: DataFrame, by: str, order: str = ORDER, rows: int | None = SEGMENT_ROWS) -> DataFrame:
    """Both registers of a server run over the same groups, so over one exchange."""
    columns = hs.columns
    segment = None if rows is None else "segment"
    if segment:
        hs = split_hot(hs, [by, "nkey"], rows, order, segment)
    hs = state_last(hs, ["nkey"], _is_syn_ack(), add_mod32("tcp_seq", 1), "nextseq", by, order, segment, rows)
    counted = state_add(
        _mark_answered(hs), ["nkey"], _open_delta(), "cnt", by, order, segment, rows, exchange=False
    )
    return counted.select(*columns, "nextseq", "cnt")


def synflood(
    packets: DataFrame, n: int = 12, by: str = EPOCH, order: str = ORDER, rows: int | None = SEGMENT_ROWS
) -> DataFrame:
    """Servers whose half-open handshakes ever exceed ``n``."""
    return flooded_servers(handshake_packets(packets, by, order), n, by, order, rows)


def flooded_servers(
    hs: DataFrame, n: int, by: str = EPOCH, order: str = ORDER, rows: int | None = SEGMENT_ROWS
) -> DataFrame:
    """Servers of handshake packets with over ``n`` half-open at some packet."""
    return report(filter_cmp(_open_handshakes(hs, by, order, rows), "cnt", "gt", n), ["nkey"], by)


def tcp_nonmonotonic(
    packets: DataFrame, by: str = EPOCH, order: str = ORDER, rows: int | None = SEGMENT_ROWS
) -> DataFrame:
    """Per TCP flow, the packets whose sequence number does not exceed all earlier ones."""
    tcp = filter_cmp(packets, "ipv4.protocol", "eq", "IP_PROTOCOLS_TCP").select(by, order, *FLOW, "tcp_seq")
    seen = state_max_seen(tcp, FLOW, "tcp.seq", "_seen", by, order, rows=rows)
    late = F.when(F.col("tcp_seq") <= F.col("_seen"), 1).otherwise(0)
    return seen.groupBy(by, *FLOW).agg(F.sum(late).cast("long").alias("count"))


def flag_counts(packets: DataFrame, flag: str, name: str, by: str = EPOCH) -> DataFrame:
    """Ones per TCP packet whose flag byte has ``flag`` set, by destination."""
    tcp = filter_cmp(packets, "ipv4.protocol", "eq", "IP_PROTOCOLS_TCP")
    hit = filter_cmp(tcp, "tcp.flags", "bit_and", flag)
    return map_cols(hit, ["ipv4.dst_addr", name], {name: 1}).select(by, "dst_addr", name)


def incomplete_flows(packets: DataFrame, n: int = 1, by: str = EPOCH) -> DataFrame:
    """Hosts with over ``n`` more connection starts (SYN) than ends (FIN)."""
    syn = syn_packets(packets).select(by, "dst_addr", F.lit(1).alias("syn"))
    fin = flag_counts(packets, "TCP_FLAG_FIN", "fin", by)
    diff = zip_diff(syn, fin, "ipv4.dst_addr", "ipv4.dst_addr", "syn", "fin", "diff", by)
    return threshold(diff, "diff", "gt", n).select(by, "dst_addr")


def newconn_cm(packets: DataFrame, d: int, width: int, n: int = 50, by: str = EPOCH) -> DataFrame:
    ones = map_cols(syn_packets(packets), ["ipv4.dst_addr", "count"], {"count": 1})
    return heavy_keys_cm(ones, ["ipv4.dst_addr"], "count", d, width, n, by=by)


def _many_distinct_sketch(
    packets: DataFrame, key: str, elem: str, bloom: tuple[int, int], cm: tuple[int, int], n: int, by: str
) -> DataFrame:
    narrow = packets.select(by, ORDER, key, elem)
    passed = bloom_distinct(narrow, sorted([key, elem]), *bloom, by=by)
    return heavy_keys_cm(map_cols(passed, [key], {"count": 1}), [key], "count", *cm, n, by=by)


def ddos_sketch(
    packets: DataFrame, bloom: tuple[int, int], cm: tuple[int, int], n: int = 180, by: str = EPOCH
) -> DataFrame:
    return _many_distinct_sketch(packets, "dst_addr", "src_addr", bloom, cm, n, by)


def portscan_sketch(
    packets: DataFrame, bloom: tuple[int, int], cm: tuple[int, int], n: int = 35, by: str = EPOCH
) -> DataFrame:
    return _many_distinct_sketch(packets, "src_addr", "dport", bloom, cm, n, by)


def superspreader_sketch(
    packets: DataFrame, bloom: tuple[int, int], cm: tuple[int, int], n: int = 200, by: str = EPOCH
) -> DataFrame:
    return _many_distinct_sketch(packets, "src_addr", "dst_addr", bloom, cm, n, by)


def synflood_cells(
    packets: DataFrame, nextseq: tuple[int, int], cnt: tuple[int, int], n: int = 12, by: str = EPOCH
) -> DataFrame:
    """SYN flood with both registers in shared cells."""
    return flooded_servers_cells(handshake_packets(packets, by), nextseq, cnt, n, by)


def flooded_servers_cells(
    hs: DataFrame,
    nextseq: tuple[int, int],
    cnt: tuple[int, int],
    n: int,
    by: str = EPOCH,
    rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """``flooded_servers`` with both registers in shared cells."""
    expected = cells_assign(
        hs, ["nkey"], _is_syn_ack(), add_mod32("tcp_seq", 1), "nextseq", *nextseq, by=by, rows=rows
    )
    counted = cells_add(
        _mark_answered(expected), ["nkey"], _open_delta(), "cnt", *cnt, by=by, rows=rows, count_from=hs
    )
    return report(filter_cmp(counted, "cnt", "gt", n), ["nkey"], by)


def flooded_servers_sizes(
    hs: DataFrame, sizes: Sequence[tuple[tuple[int, int], tuple[int, int]]], n: int, rows: int | None = SEGMENT_ROWS
) -> DataFrame:
    """(conf_id, epoch, nkey) of ``flooded_servers_cells`` for many sizes of both registers in one plan.

    The number of a configuration is part of every group, so the plan has as many steps for
    one as for many. A configuration with fewer rows than the largest repeats its first
    row, which changes no minimum.
    """
    by = ["conf_id", EPOCH]
    at = hs.select(F.explode(F.array(*[F.lit(i) for i in range(len(sizes))])).alias("conf_id"), "*")

    def placed(df: DataFrame, register: int) -> tuple[DataFrame, int]:
        own = [s[register] for s in sizes]
        deepest = max(d for d, _ in own)
        depth, width = (F.get(F.array(*[F.lit(s[k]) for s in own]), F.col("conf_id")) for k in (0, 1))
        hashed = with_row_hashes(df, ["nkey"], deepest, "_h")
        cells = {f"_cell{i}": F.when(i < depth, F.col(f"_h{i}")).otherwise(F.col("_h0")) % width for i in range(deepest)}
        return hashed.withColumns(cells).drop(*[f"_h{i}" for i in range(deepest)]), deepest

    first, d = placed(at, 0)
    scan = running_last(F.when(_is_syn_ack(), add_mod32("tcp_seq", 1)), ORDER)
    expected = running_cells(first, d, scan, 0, by, ORDER, rows, "nextseq").drop(*[f"_cell{i}" for i in range(d)])
    second, d = placed(_mark_answered(expected), 1)
    counted = running_cells(second, d, running_sum(_open_delta()), 0, by, ORDER, rows, "cnt", placed(at, 1)[0])
    return counted.where(F.col("cnt") > n).select(*by, "nkey").distinct()


def synflood_fingerprint(packets: DataFrame, d: int, width: int, n: int = 12, by: str = EPOCH) -> DataFrame:
    """SYN flood with exact registers for the servers that own a fingerprint cell."""
    tracked = state_fingerprint(handshake_packets(packets, by), ["nkey"], d, width, by)
    return flooded_servers(tracked, n, by)


def alert_packets(packets: DataFrame, keys: list[str], n: int, by: str = EPOCH, order: str = ORDER) -> DataFrame:
    """The whole packets that bring the count of their key to ``n``, once per epoch and key."""
    w = Window.partitionBy(by, *column_names(keys)).orderBy(order)
    # A rank limit: a map task keeps the first n packets of a key and shuffles no others.
    ranked = packets.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n)
    return ranked.where(F.col("_nth") == n).drop("_nth")
