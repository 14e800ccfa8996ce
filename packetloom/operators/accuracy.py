"""How well a sketched query answers: metrics per epoch and the pass/fail gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from packetloom.operators.joins import match_baseline
from packetloom.schema import EPOCH, column_names


@dataclass(frozen=True)
class AccuracySpec:
    """Accuracy intent: bounds to hold in a ``confidence`` share of the epochs."""

    precision_min: float = 0.9
    recall_min: float = 0.9
    confidence: float = 0.9
    are_max: float | None = None


def epoch_grid(
    spark: SparkSession, n_epoch: int, conf_ids: Sequence[int] | None = None, epoch: str = EPOCH
) -> DataFrame:
    """Every epoch, or every (configuration, epoch)."""
    epochs = spark.range(n_epoch).select(F.col("id").alias(epoch))
    if conf_ids is None:
        return epochs
    ids = F.array(*[F.lit(i) for i in conf_ids])
    return epochs.select(F.explode(ids).alias("conf_id"), epoch)


def _ratio(correct: Column, size: Column, other: Column) -> Column:
    """correct / size; with nothing to divide by, 1 if the other set is empty or irrelevant."""
    return F.when(size > 0, correct / size).otherwise(other)


def precision_recall(
    est: DataFrame,
    exact: DataFrame,
    keys: Sequence[str],
    n_epoch: int,
    conf_ids: Sequence[int] | None = None,
    epoch: str = EPOCH,
) -> DataFrame:
    """Precision and recall of the reported keys, for every epoch, empty ones too.

    Nothing reported is precision 1; nothing to find is recall 1. Keys reported
    where none exist are precision 0. With ``conf_ids`` the frames carry a
    ``conf_id`` column.
    """
    by = [epoch] if conf_ids is None else ["conf_id", epoch]
    counts = match_baseline(est, exact, keys, by)
    grid = epoch_grid(est.sparkSession, n_epoch, conf_ids, epoch)
    full = grid.join(counts, by, "left").na.fill(0, ["n_est", "n_exact", "n_correct"])
    one = F.lit(1.0)
    return full.select(
        *by,
        "n_est",
        "n_exact",
        "n_correct",
        _ratio(F.col("n_correct"), F.col("n_est"), one).alias("precision"),
        _ratio(F.col("n_correct"), F.col("n_exact"), one).alias("recall"),
    )


def relative_error(
    est: DataFrame,
    exact: DataFrame,
    keys: Sequence[str],
    value: str,
    n_epoch: int,
    conf_ids: Sequence[int] | None = None,
    epoch: str = EPOCH,
) -> DataFrame:
    """Mean of |estimate - true| / |true| over the exact keys.

    A missed key costs 1, and so does an estimate of a true 0 that is not 0.
    """
    by = [epoch] if conf_ids is None else ["conf_id", epoch]
    on = [*by, *column_names(keys)]
    paired = exact.select(*on, F.col(value).alias("_true")).join(
        est.select(*on, F.col(value).alias("_est")), on, "left"
    )
    off, size = F.abs(F.col("_est") - F.col("_true")), F.abs("_true")
    error = F.when(F.col("_est").isNull(), 1.0).when(size == 0, F.when(off == 0, 0.0).otherwise(1.0)).otherwise(off / size)
    per_epoch = paired.groupBy(*by).agg(F.avg(error).alias("are"))
    grid = epoch_grid(exact.sparkSession, n_epoch, conf_ids, epoch)
    return grid.join(per_epoch, by, "left").na.fill(0.0, ["are"])


def gate_rank(n_epoch: int, confidence: float) -> int:
    """0-based rank, from the best epoch down, that must still meet the bounds."""
    return max(int(n_epoch * confidence) - 1, 0)


def confidence_gate(
    metrics: DataFrame, spec: AccuracySpec, n_epoch: int, by: Sequence[str] = ()
) -> DataFrame:
    """The order statistics of the metrics at the gate's rank, and ``success``.

    ``metrics`` has one row per epoch (and group in ``by``), so a rank window
    holds ``n_epoch`` rows.
    """
    rank = gate_rank(n_epoch, spec.confidence) + 1
    measures = {"precision": F.desc, "recall": F.desc}
    if spec.are_max is not None:
        measures["are"] = F.asc
    ranked = metrics
    for m, direction in measures.items():
        ranked = ranked.withColumn(f"_r_{m}", F.row_number().over(Window.partitionBy(*by).orderBy(direction(m))))
    picked = ranked.groupBy(*by).agg(
        *[F.max(F.when(F.col(f"_r_{m}") == rank, F.col(m))).alias(m) for m in measures],
        (F.sum("n_exact") / F.lit(n_epoch)).alias("avg_keys"),
    )
    ok = (F.col("precision") >= spec.precision_min) & (F.col("recall") >= spec.recall_min)
    if spec.are_max is not None:
        ok = ok & (F.col("are") <= spec.are_max)
    return picked.withColumn("success", ok)
