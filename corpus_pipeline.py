"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept;
``run`` writes its result to the shared folder as Parquet and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import common, decontaminate, fertility, jaccard, packing, site_lines


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone``; all columns, whatever their names.

    Verdicts grow with the documents, so both sides are shuffled, on small inputs too.
    """
    rows = docs.select(F.struct("*").alias("row"), *common.row_key())
    kept = rows.join(gone.select("_key1", "_key2").hint("merge"), ["_key1", "_key2"], "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a vocabulary's band reject go."""
    judged = fertility.verdicts(spark, docs)
    return _without(docs, judged.where("not kept").distinct())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its texts; ``n_chars`` follows."""
    cleaned = site_lines.drop_boilerplate(spark, docs)
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", size)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once.

    SimHash fingerprints in BK-trees, and bands beside them, propose near copies; the shingles
    of five words in a row confirm them (similarity 0.8).
    """
    found = common.stored(spark, jaccard.near_duplicates(spark, docs), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key1", "_key2")).alias("first")
    stay = found.groupBy("root").agg(first).select("first._key1", "first._key2")
    rows = docs.select(F.struct("*").alias("row"), *common.row_key()).join(stay.hint("merge"), ["_key1", "_key2"], "left_semi")
    if not found.groupBy("_key1", "_key2").count().where("count > 1").isEmpty():  # a row that is there twice
        rows = rows.dropDuplicates(["_key1", "_key2"])
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    found = decontaminate.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("n_hit > 0"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as pieces of training sequences."""
    return packing.best_fit(docs, packing.n_words(F.col("text")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

ORACLE_SQL = None
"""Tokenisers and packing are not SQL; tests hold the stages against plain loops."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.stored(spark, stage(spark, docs, sf_dir), "stage")
    return docs
