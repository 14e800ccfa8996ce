"""What the operators share: stored steps, row keys, bounded slices of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.sources.shared import shared_dir

SLICE_BYTES = 4 << 20
"""Bytes of text that a Python task looks at together."""


def stored(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """``df``, written to the shared folder and read back: its lineage ends here, and
    an executor that is lost later takes nothing with it."""
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """96 bits that name a row by its id and text, the same in every evaluation.

    Rows that agree in both are one document. Nulls count as values of their own.
    """
    parts = [F.col(doc_id), F.col(doc_id).isNull(), F.col(text), F.col(text).isNull()]
    return [F.xxhash64(*parts).alias("_key1"), F.hash(*parts).alias("_key2")]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first, total = 0, 0
        for i, size in enumerate(sizes):
            if total + size > limit and i > first:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += size
        if first < len(sizes):
            yield batch.slice(first)


def texts(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(text).to_pylist()]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Rows kept out of training: CRC-32 of the id as text leaves ``fold``. A null id is trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
