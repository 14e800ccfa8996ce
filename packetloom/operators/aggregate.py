"""Sums, counts and thresholds per epoch and key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from packetloom.operators.basic import filter_cmp
from packetloom.operators.running import SEGMENT_ROWS, running, running_sum
from packetloom.schema import EPOCH, ORDER, column_names


def reduce_sum(df: DataFrame, keys: Sequence[str], result: str, by: str = EPOCH) -> DataFrame:
    """Sum of ``result`` per epoch and key."""
    return df.groupBy(by, *column_names(keys)).agg(F.sum(result).cast("long").alias(result))


def reduce_running(
    df: DataFrame,
    keys: Sequence[str],
    result: str,
    out: str | None = None,
    by: str = EPOCH,
    order: str = ORDER,
    rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """Attach to each packet the sum of ``result`` over its key up to that packet."""
    out = out or result
    summed = running(df, [by, *column_names(keys)], {"_sum": running_sum(F.col(result))}, order, rows=rows)
    return summed.withColumn(out, F.col("_sum").cast("long")).drop("_sum")


def threshold(df: DataFrame, value: str, op: str, n: int) -> DataFrame:
    """Keep groups whose value reaches (``ge``) or exceeds (``gt``) ``n``."""
    if op not in ("ge", "gt"):
        raise ValueError("a threshold is 'ge' or 'gt'")
    return filter_cmp(df, value, op, n)


def threshold_crossing(
    df: DataFrame,
    keys: Sequence[str],
    result: str,
    n: int,
    out: str = "running",
    by: str = EPOCH,
    order: str = ORDER,
    rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """The packets at which the running sum of their key comes to ``n`` from below.

    With unit steps this is the test ``running == n``.
    """
    run = reduce_running(df, keys, result, out, by, order, rows)
    return run.where((F.col(out) >= n) & (F.col(out) - F.col(result) < n))


def distinct_count(
    df: DataFrame,
    keys: Sequence[str],
    elems: Sequence[str],
    out: str = "count",
    by: str = EPOCH,
    approximate: bool = False,
) -> DataFrame:
    """Number of distinct elements per epoch and key."""
    cols = [F.col(c) for c in column_names(elems)]
    if approximate:
        counted = F.approx_count_distinct(F.struct(*cols) if len(cols) > 1 else cols[0])
    else:
        counted = F.count_distinct(*cols)
    return df.groupBy(by, *column_names(keys)).agg(counted.alias(out))


def distinct_sketches(
    df: DataFrame,
    keys: Sequence[str],
    elems: Sequence[str],
    out: str = "sketch",
    by: str = EPOCH,
    lg_size: int = 12,
) -> DataFrame:
    """A sketch of the distinct elements per epoch and key, to be stored and merged later.

    An element with a null counts for nothing, as in ``distinct_count``. A sketch holds
    2^``lg_size`` small registers at most.
    """
    cols = [F.col(c) for c in column_names(elems)]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    element = F.when(whole, F.xxhash64(*cols))
    return df.groupBy(by, *column_names(keys)).agg(F.hll_sketch_agg(element, lg_size).alias(out))


def merged_distinct_count(
    sketches: DataFrame, keys: Sequence[str], out: str = "count", sketch: str = "sketch"
) -> DataFrame:
    """Estimated number of distinct elements per key over all rows of sketches.

    Give the epoch, or any rough time made from it, among the keys to merge less. The relative
    standard error is about 0.83 / sqrt(2^lg_size) for merged sketches of many elements.
    """
    merged = F.hll_union_agg(sketch)
    return sketches.groupBy(*column_names(keys)).agg(F.hll_sketch_estimate(merged).cast("long").alias(out))
