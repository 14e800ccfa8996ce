"""Sketch sizes as JSON: ``{table: {"d": rows, "w": pages}}``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_sketch_conf(spark: SparkSession, path: str) -> DataFrame:
    """(table, d, w), one row per table of the configuration."""
    whole = spark.read.text(path, wholetext=True)
    tables = F.from_json("value", "map<string, struct<d: int, w: int>>")
    return whole.select(F.explode(tables).alias("table", "_size")).select("table", "_size.d", "_size.w")


def write_sketch_conf(spark: SparkSession, conf: DataFrame, path: str) -> None:
    """Write (table, d, w) rows as one JSON document; a configuration has a few tables."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", F.struct("d", "w")))))
    conf.agg(F.to_json(pairs).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def sketch_sizes(conf: DataFrame) -> Mapping[str, tuple[int, int]]:
    """The few sizes of a configuration as plain numbers, to build a query with."""
    return {r["table"]: (r["d"], r["w"]) for r in conf.collect()}
