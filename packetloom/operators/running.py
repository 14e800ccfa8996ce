"""Running values over ordered packets that no hot key can overload.

A running sum over ``partitionBy(key).orderBy(pkt_no)`` puts every packet of a
key into one task. Here a group with more than ``rows`` packets is cut into
segments of consecutive packet numbers: each segment is scanned by its own task,
segment totals are aggregated with map-side combine, and the prefix of the
totals of the earlier segments is joined back on. Ordinary groups keep the plain
one-shuffle window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from packetloom.functions.scalar import floor_div
from packetloom.schema import ORDER

SEGMENT_ROWS = 1 << 22
NO_SEGMENT = -1

_START = Window.unboundedPreceding


@dataclass(frozen=True)
class Scan:
    """A running value: inside a segment, per segment, over segments, and combined."""

    local: Callable[[WindowSpec], Column]
    total: Column
    prefix: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


def running_sum(value: Column) -> Scan:
    """Sum of the packets so far, this one included."""
    return Scan(
        local=lambda w: F.sum(value).over(w.rowsBetween(_START, 0)),
        total=F.sum(value),
        prefix=lambda total, w: F.sum(total).over(w),
        merge=lambda carry, local: F.coalesce(carry, F.lit(0)) + local,
    )


def running_last(value: Column, order: str = ORDER) -> Scan:
    """Last non-null value so far, this packet included."""
    return Scan(
        local=lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(_START, 0)),
        total=F.max_by(value, F.when(value.isNotNull(), F.col(order))),
        prefix=lambda total, w: F.last(total, ignorenulls=True).over(w),
        merge=lambda carry, local: F.coalesce(local, carry),
    )


def running_max(value: Column) -> Scan:
    """Maximum so far, this packet included."""
    return Scan(
        local=lambda w: F.max(value).over(w.rowsBetween(_START, 0)),
        total=F.max(value),
        prefix=lambda total, w: F.max(total).over(w),
        merge=lambda carry, local: F.greatest(carry, local),
    )


def max_before(value: Column) -> Scan:
    """Maximum over the earlier packets, null on the first."""
    return Scan(
        local=lambda w: F.max(value).over(w.rowsBetween(_START, -1)),
        total=F.max(value),
        prefix=lambda total, w: F.max(total).over(w),
        merge=lambda carry, local: F.greatest(carry, local),
    )


def previous(value: Column, order: str = ORDER) -> Scan:
    """Value of the packet just before, null on the first."""
    return Scan(
        local=lambda w: F.lag(value).over(w),
        total=F.max_by(value, F.col(order)),
        prefix=lambda total, w: F.last(total, ignorenulls=True).over(w),
        merge=lambda carry, local: F.coalesce(local, carry),
    )


def split_hot(
    df: DataFrame,
    keys: Sequence[str],
    rows: int | None = SEGMENT_ROWS,
    order: str = ORDER,
    name: str = "segment",
    count_from: DataFrame | None = None,
) -> DataFrame:
    """Add the segment number of packets in groups of more than ``rows`` packets.

    Other packets get ``NO_SEGMENT``. The hot groups are few by construction: N
    packets hold at most N / rows of them, which is what bounds the broadcast.
    ``count_from`` names a cheaper frame with the same packets to count on.
    ``rows=None`` asks for no splitting.
    """
    if rows is None:
        return df.withColumn(name, F.lit(NO_SEGMENT).cast("long"))
    counted = df if count_from is None else count_from
    hot = (
        counted.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn(
            name,
            F.when(F.col("_hot"), floor_div(order, rows)).otherwise(F.lit(NO_SEGMENT)).cast("long"),
        )
        .drop("_hot")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    scans: Mapping[str, Scan],
    order: str = ORDER,
    segment: str | None = None,
    rows: int | None = SEGMENT_ROWS,
    source: DataFrame | None = None,
    exchange: bool = True,
) -> DataFrame:
    """Add one column per scan, computed in packet order inside each key group.

    ``segment`` is a column already made by :func:`split_hot` for these keys.
    ``source`` holds the same packets before costlier steps, when the scans read
    only its columns; hot groups and segment totals are then taken from it.
    ``exchange=False`` says the frame comes from a scan over the same groups.
    """
    keys = list(keys)
    own = segment is None
    kept = df.columns
    if own and rows is None:
        w = Window.partitionBy(*keys).orderBy(order)
        local = df.withColumns({out: s.local(w) for out, s in scans.items()})
        return local.withColumns({out: s.merge(F.lit(None), F.col(out)) for out, s in scans.items()})
    base = df if source is None else source
    if own:
        # One count per group and possible segment tells the hot groups, and carries what
        # the segments before add up to. Only hot ones are sent: N packets fill N / rows
        # segments, and each hot group adds one that is not full.
        cut = floor_div(order, rows)
        group = Window.partitionBy(*keys)
        before = group.orderBy("_segment").rowsBetween(_START, -1)
        parts = base.groupBy(*keys, cut.alias("_segment")).agg(
            F.count(F.lit(1)).alias("_n"), *[s.total.alias(f"_t{i}") for i, s in enumerate(scans.values())]
        )
        prefixes = [s.prefix(F.col(f"_t{i}"), before).alias(f"_p{i}") for i, s in enumerate(scans.values())]
        hot = parts.select(*keys, "_segment", *prefixes, F.sum("_n").over(group).alias("_size")).where(F.col("_size") > rows)
        placed = df.withColumn("_segment", cut).join(F.broadcast(hot), [*keys, "_segment"], "left")
        own_segment = F.when(F.col("_size").isNotNull(), F.col("_segment")).otherwise(F.lit(NO_SEGMENT)).cast("long")
        placed = placed.withColumn("_segment", own_segment)
        placed = placed.repartition(*keys, "_segment") if exchange else placed
        w = Window.partitionBy(*keys, "_segment").orderBy(order)
        merged = [s.merge(F.col(f"_p{i}"), s.local(w)).alias(out) for i, (out, s) in enumerate(scans.items())]
        return placed.select(*kept, *merged)

    totals = (
        base.where(F.col(segment) != NO_SEGMENT)
        .groupBy(*keys, segment)
        .agg(*[s.total.alias(f"_t{i}") for i, s in enumerate(scans.values())])
    )
    earlier = Window.partitionBy(*keys).orderBy(segment).rowsBetween(_START, -1)
    carry = totals.select(
        *keys,
        segment,
        *[s.prefix(F.col(f"_t{i}"), earlier).alias(f"_p{i}") for i, s in enumerate(scans.values())],
    )
    # Without this exchange an input partitioned by the bare keys would satisfy
    # the window and keep a hot group whole.
    placed = df.repartition(*keys, segment) if exchange else df
    w = Window.partitionBy(*keys, segment).orderBy(order)
    local = placed.select("*", *[s.local(w).alias(f"_l{i}") for i, s in enumerate(scans.values())])
    joined = local.join(carry, [*keys, segment], "left")
    return joined.select(
        *kept,
        *[s.merge(F.col(f"_p{i}"), F.col(f"_l{i}")).alias(out) for i, (out, s) in enumerate(scans.items())],
    )


def running_over_all(
    df: DataFrame, scans: Mapping[str, Scan], order: str = ORDER, rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Running values over the whole trace: every packet belongs to a segment."""
    cut = df.withColumn("_segment", floor_div(order, rows))
    return running(cut, [], scans, order, segment="_segment").drop("_segment")
