"""De-duplication per epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from packetloom.schema import EPOCH, ORDER, column_names


def first_rows(df: DataFrame, keys: Sequence[str], order: str = ORDER) -> DataFrame:
    """The first whole row of every group.

    A rank filter, so that each map task sends at most one row per group.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def distinct_first(df: DataFrame, keys: Sequence[str], by: str = EPOCH, order: str = ORDER) -> DataFrame:
    """Pass the first packet of each key in an epoch, drop the later ones."""
    return first_rows(df, [by, *column_names(keys)], order)


def distinct_keys(df: DataFrame, keys: Sequence[str], by: str = EPOCH) -> DataFrame:
    """The set of keys of each epoch."""
    return df.select(by, *column_names(keys)).distinct()
