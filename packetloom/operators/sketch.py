"""Approximate operators over Bloom, Count-Min and fingerprint tables.

A sketch of ``d`` rows and ``width`` cells is the set of (epoch, row, cell)
groups of an ordinary frame, so Spark partitions, combines and spills it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.hashing import cell_array, explode_cells, with_cells
from packetloom.functions.scalar import floor_div
from packetloom.operators.distinct import first_rows
from packetloom.operators.joins import signed_union
from packetloom.operators.running import NO_SEGMENT, SEGMENT_ROWS, Scan, running, running_last, running_sum
from packetloom.schema import EPOCH, ORDER, Operand, column_name, column_names, operand

PAGE_BYTES = 16384


def cells_per_row(pages: int, value_bits: int, page_bytes: int = PAGE_BYTES) -> int:
    """Cells in a sketch row of ``pages`` memory pages."""
    return pages * page_bytes * 8 // value_bits


def bloom_distinct(
    df: DataFrame, keys: Sequence[str], d: int, width: int, by: str = EPOCH, order: str = ORDER
) -> DataFrame:
    """Pass a packet when one of its ``d`` bits is still unset, then set them.

    A bit is unset exactly at the first packet that touches it, so the passing
    packets are the first touchers of the cells. Keys whose bits were all set by
    others are lost.
    """
    # Narrow rows decide; whole packets meet them again by number.
    touched = explode_cells(df.select(by, order, *column_names(keys)), keys, d, width)
    first = first_rows(touched, [by, "row", "cell"], order)
    return df.join(first.select(by, order).distinct(), [by, order], "left_semi").select(*df.columns)


def non_negative(value: Column) -> Column:
    """``value``; fails on a negative one, for tables whose cells must only grow."""
    message = F.format_string("a Count-Min adds only non-negative values, not %s", value.cast("string"))
    return F.when(value < 0, F.raise_error(message).cast("long")).otherwise(value)


def _with_totals(sums: DataFrame, keys: Sequence[str], values: Sequence[str], d: int, width: int, by: str) -> DataFrame:
    """``sums`` (one row per key) with the cell totals ``{value}{i}`` of every sketch row.

    Cell totals are at most ``width`` rows per epoch and sketch row, so one row per key
    meets each of them by a join of its own and never leaves its place.
    """
    at = placed = with_cells(sums, keys, d, width, "_cell")
    for i in range(d):
        totals = placed.groupBy(by, f"_cell{i}").agg(*[F.sum(v).alias(f"{v}{i}") for v in values])
        at = at.join(totals, [by, f"_cell{i}"])
    return at


def _least(names: Sequence[str]) -> Column:
    return F.least(*names) if len(names) > 1 else F.col(names[0])


def _hot_cells(cells: DataFrame, d: int, rows: int, by: Sequence[str]) -> DataFrame:
    """Cells of all sketch rows that more than ``rows`` packets touch, in one aggregate."""
    at = cells.select(*by, F.inline(cell_array(d, "_cell")))
    counted = at.groupBy(*by, "row", "cell").agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") > rows).drop("_n")


def _running_min(
    df: DataFrame, keys: Sequence[str], d: int, width: int, scan: Scan, empty: int, by: str, order: str,
    rows: int | None, out: str, count_from: DataFrame | None = None,
) -> DataFrame:
    """Run ``scan`` in every sketch row and take the least value at each packet.

    ``count_from`` names a cheaper frame with the same packets to count on.
    """
    ks = column_names(keys)
    at = with_cells(df, ks, d, width, "_cell")
    counted = at if count_from is None else with_cells(count_from, ks, d, width, "_cell")
    return running_cells(at, d, scan, empty, [by], order, rows, out, counted).select(*[c for c in df.columns if c != out], out)


def running_cells(
    at: DataFrame,
    d: int,
    scan: Scan,
    empty: int,
    by: Sequence[str],
    order: str,
    rows: int | None,
    out: str,
    counted: DataFrame | None = None,
) -> DataFrame:
    """The least of ``scan`` over the groups ``_cell0`` .. of each packet, within ``by``.

    The rows are scanned one after the other on whole packets, which needs no
    join to bring the ``d`` values of a packet together again. Hot cells and the
    totals of their segments come from one aggregate each for all rows.
    """
    kept = [c for c in at.columns if c != out]
    if rows is None:
        for i in range(d):
            at = running(at, [*by, f"_cell{i}"], {f"_v{i}": scan}, order, rows=None)
    else:
        at = _segmented_rows(at, at if counted is None else counted, d, scan, by, order, rows)
    values = [F.coalesce(F.col(f"_v{i}"), F.lit(empty)).cast("long") for i in range(d)]
    return at.select(*kept, (F.least(*values) if d > 1 else values[0]).alias(out))


def _segmented_rows(
    at: DataFrame, counted: DataFrame, d: int, scan: Scan, by: Sequence[str], order: str, rows: int
) -> DataFrame:
    hot = _hot_cells(counted, d, rows, by)
    cut = floor_div(order, rows)
    for i in range(d):
        mine = hot.where(F.col("row") == i).select(*by, F.col("cell").alias(f"_cell{i}"), F.lit(True).alias("_hot"))
        segment = F.when(F.col("_hot"), cut).otherwise(F.lit(NO_SEGMENT)).cast("long")
        # At most d * N / rows cells of N packets are hot; Spark checks what that comes to.
        at = at.join(mine, [*by, f"_cell{i}"], "left").withColumn(f"_seg{i}", segment).drop("_hot")

    pieces = F.array(
        *[
            F.struct(F.lit(i).alias("row"), F.col(f"_cell{i}").alias("cell"), F.col(f"_seg{i}").alias("segment"))
            for i in range(d)
        ]
    )
    in_segment = F.filter(pieces, lambda p: p["segment"] != NO_SEGMENT)
    totals = (
        at.where(F.size(in_segment) > 0)
        .select("*", F.inline(in_segment))
        .groupBy(*by, "row", "cell", "segment")
        .agg(scan.total.alias("_total"))
    )
    earlier = Window.partitionBy(*by, "row", "cell").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, "row", "cell", "segment", scan.prefix(F.col("_total"), earlier).alias("_carry"))
    for i in range(d):
        group = [*by, f"_cell{i}", f"_seg{i}"]
        mine = carry.where(F.col("row") == i).select(
            *by, F.col("cell").alias(f"_cell{i}"), F.col("segment").alias(f"_seg{i}"), "_carry"
        )
        local = at.repartition(*group).withColumn(f"_v{i}", scan.local(Window.partitionBy(*group).orderBy(order)))
        at = (
            local.join(mine, group, "left")
            .withColumn(f"_v{i}", scan.merge(F.col("_carry"), F.col(f"_v{i}")))
            .drop("_carry")
        )
    return at


def reduce_cm(
    df: DataFrame,
    keys: Sequence[str],
    result: str,
    d: int,
    width: int,
    mode: str = "running",
    out: str = "estimate",
    by: str = EPOCH,
    order: str = ORDER,
    rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """Count-Min sum of the non-negative ``result`` by key.

    ``running`` attaches the estimate after each packet to that packet; ``final``
    gives one row per key with its estimate at the end of the epoch.
    """
    if mode == "running":
        return _running_min(df, keys, d, width, running_sum(non_negative(F.col(result))), 0, by, order, rows, out)
    if mode != "final":
        raise ValueError("mode is 'running' or 'final'")
    ks = column_names(keys)
    # Cells are sums of key sums, so the packets shrink to one row per key first.
    sums = df.groupBy(by, *ks).agg(F.sum(non_negative(F.col(result))).cast("long").alias("_total"))
    at = _with_totals(sums, ks, ["_total"], d, width, by)
    return at.select(by, *ks, _least([f"_total{i}" for i in range(d)]).cast("long").alias(out))


def heavy_keys_cm(
    df: DataFrame,
    keys: Sequence[str],
    result: str,
    d: int,
    width: int,
    n: int,
    mode: str = "running",
    by: str = EPOCH,
    order: str = ORDER,
    rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """Keys whose Count-Min estimate reaches ``n``.

    In ``running`` mode a key counts when the estimate at one of its own packets
    does; later packets of other keys in its cells do not report it.
    """
    ks = column_names(keys)
    if mode == "final":
        est = reduce_cm(df, ks, result, d, width, "final", "_est", by)
        return est.where(F.col("_est") >= n).select(by, *ks)
    if mode != "running":
        raise ValueError("mode is 'running' or 'final'")
    # Cells only grow, so the estimate reaches n at a packet of the key exactly
    # when each of its cells does at some packet of the key.
    at = explode_cells(df.select(by, order, *ks, result), ks, d, width)
    summed = running(at, [by, "row", "cell"], {"_sum": running_sum(non_negative(F.col(result)))}, order, rows=rows)
    most = summed.groupBy(by, *ks, "row").agg(F.max("_sum").alias("_most"))
    reached = most.groupBy(by, *ks).agg(F.sum(F.when(F.col("_most") >= n, 1).otherwise(0)).alias("_rows"))
    return reached.where(F.col("_rows") == d).select(by, *ks)


def zip_diff_cm(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    a: str,
    b: str,
    d: int,
    width: int,
    out: str = "diff",
    by: str = EPOCH,
) -> DataFrame:
    """Difference of two streams from a positive and a negative Count-Min.

    Both tables share their cells, so one pass builds them.
    """
    key = column_name(left_key)
    signed = signed_union(left, right, left_key, right_key, a, b, "_v", by)
    plus, minus = F.greatest(F.col("_v"), F.lit(0)), F.greatest(-F.col("_v"), F.lit(0))
    sums = signed.groupBy(by, key).agg(F.sum(plus).alias("_plus"), F.sum(minus).alias("_minus"))
    at = _with_totals(sums, [key], ["_plus", "_minus"], d, width, by)
    plus, minus = (_least([f"{v}{i}" for i in range(d)]) for v in ("_plus", "_minus"))
    return at.select(by, key, (plus - minus).cast("long").alias(out))


def cells_add(
    df: DataFrame,
    keys: Sequence[str],
    delta: Column,
    out: str,
    d: int,
    width: int,
    by: str = EPOCH,
    order: str = ORDER,
    rows: int | None = SEGMENT_ROWS,
    count_from: DataFrame | None = None,
) -> DataFrame:
    """Register shared by the keys of a cell, changed by ``+= delta`` in every row."""
    return _running_min(df, keys, d, width, running_sum(delta), 0, by, order, rows, out, count_from)


def cells_assign(
    df: DataFrame,
    keys: Sequence[str],
    cond: Column,
    value: Operand,
    out: str,
    d: int,
    width: int,
    by: str = EPOCH,
    order: str = ORDER,
    rows: int | None = SEGMENT_ROWS,
    count_from: DataFrame | None = None,
) -> DataFrame:
    """Register shared by the keys of a cell, assigned in every row where ``cond`` holds."""
    scan = running_last(F.when(cond, operand(value)), order)
    return _running_min(df, keys, d, width, scan, 0, by, order, rows, out, count_from)


def state_shared_cells(
    df: DataFrame,
    keys: Sequence[str],
    d: int,
    width: int,
    update: tuple,
    out: str,
    by: str = EPOCH,
    order: str = ORDER,
    rows: int | None = SEGMENT_ROWS,
    count_from: DataFrame | None = None,
) -> DataFrame:
    """Approximate register: ``("add", delta)`` or ``("assign", cond, value)``.

    The update may read other columns, not the register it writes.
    """
    kind, *args = update
    if kind == "add":
        return cells_add(df, keys, *args, out, d, width, by, order, rows, count_from)
    if kind == "assign":
        return cells_assign(df, keys, *args, out, d, width, by, order, rows, count_from)
    raise ValueError("an update is ('add', delta) or ('assign', cond, value)")


def fingerprint_owners(
    df: DataFrame, keys: Sequence[str], d: int, width: int, by: str = EPOCH, order: str = ORDER
) -> DataFrame:
    """The keys that own a cell, with the sketch ``row`` in which they do.

    A key asks for its cells at its first packet, so one row per key decides:
    the earliest key of a cell owns it and the others go on to the next row.
    """
    ks = column_names(keys)
    firsts = df.groupBy(by, *ks).agg(F.min(order).alias("_first"))
    left = with_cells(firsts, ks, d, width, "_cell").withColumn("row", F.lit(None).cast("int"))
    for i in range(d):
        free = F.when(F.col("row").isNull(), F.col("_first"))
        # Combined in the map tasks: a cell has one earliest key however many ask for it.
        owners = left.groupBy(by, f"_cell{i}").agg(F.min(free).alias("_owner"))
        left = (
            left.join(owners, [by, f"_cell{i}"])
            .withColumn("row", F.when(free == F.col("_owner"), F.lit(i)).otherwise(F.col("row")))
            .drop("_owner")
        )
    return left.where(F.col("row").isNotNull()).select(by, *ks, "row")


def state_fingerprint(
    df: DataFrame, keys: Sequence[str], d: int, width: int, by: str = EPOCH, order: str = ORDER
) -> DataFrame:
    """Packets of the keys that own a cell; exact registers then run on these."""
    owners = fingerprint_owners(df, keys, d, width, by, order)
    return df.join(owners, [by, *column_names(keys)])
