"""Zipping two packet streams and comparing result sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from packetloom.schema import EPOCH, column_name, column_names


def zip_streams(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    by: str = EPOCH,
) -> DataFrame:
    """Merge two streams on epoch and key; the key keeps its left name."""
    lk, rk = column_name(left_key), column_name(right_key)
    return left.join(right.withColumnRenamed(rk, lk), [by, lk], how)


def signed_union(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    a: str,
    b: str,
    out: str,
    by: str = EPOCH,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Rows (epoch, key, out): ``+a`` from the left stream, ``-b`` from the right."""
    lk, rk = column_name(left_key), column_name(right_key)
    plus = left.select(by, F.col(lk), F.col(a).cast("long").alias(out), *carry)
    minus = right.select(by, F.col(rk).alias(lk), (-F.col(b)).cast("long").alias(out), *carry)
    return plus.unionByName(minus)


def zip_diff(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    a: str,
    b: str,
    out: str = "diff",
    by: str = EPOCH,
) -> DataFrame:
    """Difference of two streams per epoch and key, absent keys counting 0.

    One signed sum over the union, so a single shuffle with map-side combine.
    """
    lk = column_name(left_key)
    signed = signed_union(left, right, left_key, right_key, a, b, out, by)
    return signed.groupBy(by, lk).agg(F.sum(out).cast("long").alias(out))


def match_sets(est: DataFrame, exact: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per key of either set with flags ``in_est`` and ``in_exact``."""
    on = [*by, *column_names(keys)]
    e = est.select(*on).withColumn("in_est", F.lit(1))
    x = exact.select(*on).withColumn("in_exact", F.lit(1))
    return e.join(x, on, "full").na.fill(0, ["in_est", "in_exact"])


def match_baseline(
    est: DataFrame, exact: DataFrame, keys: Sequence[str], by: str | Sequence[str] = EPOCH
) -> DataFrame:
    """Per epoch: how many keys were reported, how many are right, how many exist."""
    by = [by] if isinstance(by, str) else list(by)
    matched = match_sets(est, exact, keys, by)
    return matched.groupBy(*by).agg(
        F.sum("in_est").cast("long").alias("n_est"),
        F.sum("in_exact").cast("long").alias("n_exact"),
        F.sum(F.col("in_est") * F.col("in_exact")).cast("long").alias("n_correct"),
    )
