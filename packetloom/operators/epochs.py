"""Tumbling epochs anchored at the first packet."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.functions.scalar import floor_div
from packetloom.operators.running import SEGMENT_ROWS, running_max, running_over_all
from packetloom.schema import EPOCH, ORDER


def _anchor(df: DataFrame, anchor: str | datetime, ts: str, order: str) -> Column:
    if isinstance(anchor, datetime):
        return F.unix_micros(F.lit(anchor))
    micros = F.unix_micros(F.col(ts))
    if anchor == "first":
        return df.select(F.min_by(micros, F.col(order))).scalar()
    if anchor == "earliest":
        return df.select(F.min(micros)).scalar()
    raise ValueError("anchor is 'first', 'earliest' or a timestamp")


def with_epoch(
    df: DataFrame,
    interval: float,
    anchor: str | datetime = "first",
    ts: str = "ts",
    order: str = ORDER,
    out: str = EPOCH,
) -> DataFrame:
    """Number the half-open epochs of ``interval`` seconds from the anchor.

    The anchor is a scalar subquery: one aggregated value, never collected.
    """
    step = round(interval * 1_000_000)
    start = _anchor(df, anchor, ts, order)
    return df.withColumn(out, floor_div(F.unix_micros(F.col(ts)) - start, step))


def clamp_epoch(df: DataFrame, epoch: str = EPOCH, order: str = ORDER, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Put a packet that is late by its timestamp into the epoch then running."""
    late = running_over_all(df, {"_seen": running_max(F.col(epoch))}, order, rows)
    return late.withColumn(epoch, F.greatest(F.col("_seen"), F.lit(0).cast("long"))).drop("_seen")


def enough_epochs(df: DataFrame, n_epoch: int, epoch: str = EPOCH) -> Column:
    """True; fails when the trace ends before ``n_epoch`` epochs are complete."""
    last = F.coalesce(df.select(F.max(epoch)).scalar(), F.lit(-1))
    message = F.format_string("the trace ends in epoch %d of %d", last, F.lit(n_epoch))
    return F.when(last < F.lit(n_epoch), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def n_complete(df: DataFrame, epoch: str = EPOCH) -> int:
    """Epochs of the trace before its last, unfinished one. Runs one small aggregate."""
    return max(df.select(F.max(epoch)).first()[0] or 0, 0)


def complete_epochs(df: DataFrame, n_epoch: int | None = None, epoch: str = EPOCH) -> DataFrame:
    """Keep the first ``n_epoch`` epochs, never the last, unfinished one.

    Fails when the trace ends before ``n_epoch`` epochs are complete.
    """
    if n_epoch is None:
        return df.where(F.col(epoch) < df.select(F.max(epoch)).scalar())
    return df.where((F.col(epoch) < n_epoch) & enough_epochs(df, n_epoch, epoch))


def fill_epochs(
    spark: SparkSession, counts: DataFrame, n_epoch: int, values: Sequence[str], epoch: str = EPOCH
) -> DataFrame:
    """One row for every epoch below ``n_epoch``, with 0 for the values of empty ones."""
    every = spark.range(n_epoch).withColumnRenamed("id", epoch)
    return every.join(counts, epoch, "left").na.fill(0, list(values))
