"""Line dedup by site-relative frequency: a line on many pages of one host is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import stored

MAX_RATIO = 0.1
"""A line on more than this share of a host's pages is dropped."""

MIN_PAGES = 5
"""... and on at least so many of them, so that small hosts keep theirs."""


def _mark(line: Column) -> Column:
    """96 bits of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(
    spark: SparkSession,
    docs: DataFrame,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    host: str = "source",
    text: str = "text",
) -> DataFrame:
    """Per host, the marks of lines to drop: ``host, n_pages, marks``.

    A page counts once for a line that it repeats. Both counts are combined in the map
    tasks, so a host with a third of all pages is no hot group. A host's list has at most
    (lines per page) / ``max_ratio`` marks, whatever the number of its pages. Null is a host
    of its own; null texts count as pages without lines; blank lines are no lines.
    """
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    lines = F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)))
    marks = F.transform(F.filter(lines, lambda x: x != ""), _mark)
    seen = pages.select("host", F.explode(marks).alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n"))
    counted = seen.where(F.col("n") >= min_pages).select(F.col("host").alias("_host"), "mark", "n")
    often = counted.join(totals, F.col("_host").eqNullSafe(F.col("host"))).where(F.col("n") > max_ratio * F.col("n_pages"))
    found = often.groupBy("host", "n_pages").agg(F.collect_list("mark").alias("marks"))
    return stored(spark, found, "boilerplate")


def drop_boilerplate(
    spark: SparkSession,
    docs: DataFrame,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    host: str = "source",
    text: str = "text",
    n_dropped: str | None = None,
) -> DataFrame:
    """``docs`` with the boilerplate lines of their host taken out of ``text``.

    All rows and columns stay; a text may become empty, a null one stays null, and the
    other lines keep their bytes and order. ``n_dropped`` names a column for the number of
    lines taken out. The list of lines is stored first, so that Spark knows its size and
    broadcasts it only below its own threshold; beyond, hosts are joined by shuffle.
    """
    gone = boilerplate(spark, docs, max_ratio, min_pages, host, text).select(F.col("host").alias("_host"), F.col("marks").alias("_marks"))
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("_text"), F.col(host).alias("_own"))
    joined = rows.join(gone, F.col("_own").eqNullSafe(F.col("_host")), "left")
    lines = F.split("_text", "\n", -1)
    kept = F.filter(lines, lambda x: ~F.array_contains("_marks", _mark(F.trim(x))))
    changed = joined.withColumn("_kept", F.when(F.col("_marks").isNotNull(), kept))
    columns = [F.col("row").getField(c) for c in docs.columns]
    columns[docs.columns.index(text)] = F.coalesce(F.array_join("_kept", "\n"), F.col("_text"))
    out = [c.alias(name) for c, name in zip(columns, docs.columns, strict=True)]
    if n_dropped:
        out.append(F.coalesce(F.size(lines) - F.size(F.coalesce("_kept", lines)), F.lit(0)).cast("long").alias(n_dropped))
    return changed.select(*out)
