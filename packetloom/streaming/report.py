"""Reports of a streamed detection, epoch by epoch, empty epochs too."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from packetloom.schema import EPOCH, column_names
from packetloom.streaming.windows import WINDOW, window_epoch, with_window

EPOCHS = T.StructType([T.StructField(EPOCH, T.LongType()), T.StructField("packets", T.LongType())])


def _last_before(spark: SparkSession, path: str, batch: int) -> int:
    """The last epoch that micro-batches before ``batch`` reported, -1 if none."""
    try:
        written = spark.read.schema(f"{EPOCH} bigint, batch bigint").parquet(f"{path}/epochs")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    last = written.where(F.col("batch") < batch).agg(F.max(EPOCH)).first()[0]
    return -1 if last is None else last


def write_report(batch: DataFrame, number: int, path: str, after: int) -> int:
    """Write what one micro-batch closed, in folders of its own; the last epoch reported.

    ``batch`` has ``epoch``, and either ``packets`` (one row per epoch that had any) or
    ``found``. Epochs above ``after`` without packets are added. Running it again with the
    same number replaces what it wrote.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    spine = batch.where(F.col("packets").isNotNull()).select(EPOCH, "packets")
    last = spine.agg(F.max(EPOCH)).first()[0]
    if last is None:
        batch.unpersist()
        return after
    found = batch.where(F.col("found").isNotNull()).select(EPOCH, "found.*")
    found.write.mode("overwrite").parquet(f"{path}/found/batch={number}")
    every = spark.range(after + 1, last + 1).withColumnRenamed("id", EPOCH)
    # The epochs come last: an epoch that is listed has all its rows.
    filled = every.join(spine, EPOCH, "left").na.fill(0, ["packets"])
    filled.write.mode("overwrite").parquet(f"{path}/epochs/batch={number}")
    batch.unpersist()
    return last


def report_stream(
    packets: DataFrame,
    detection: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    path: str,
    progress: str,
    interval: float = 0.5,
    start_us: int = 0,
    *,
    watermark: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Write the keys that ``detection`` finds in each epoch once the watermark has closed it.

    ``detection`` gets packets with a ``window`` and returns ``window`` and the keys. Every
    epoch from ``start_us`` on is reported once, those in which nothing was found and those
    without a packet too; the latter with the next epoch that has packets, as only packets
    move the watermark. A micro-batch that is run again after a failure writes the same
    folders again. ``read_report`` and ``read_found`` read ``path``.
    """
    names = column_names(keys)
    seen = with_window(packets, interval, watermark, start_us)
    epoch = window_epoch(interval, start_us)
    found = detection(seen).select(epoch, F.lit(None).cast("long").alias("packets"), F.struct(*names).alias("found"))
    nothing = F.lit(None).cast(found.schema["found"].dataType).alias("found")
    spine = seen.groupBy(WINDOW).agg(F.count(F.lit(1)).alias("packets")).select(epoch, "packets", nothing)
    last: list[int] = []

    def sink(batch: DataFrame, number: int) -> None:
        after = last.pop() if last else _last_before(batch.sparkSession, path, number)
        last.append(write_report(batch, number, path, after))

    writer = (
        found.unionByName(spine)
        .writeStream.outputMode("append")
        .option("checkpointLocation", progress)
        .foreachBatch(sink)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """``epoch, packets`` of every reported epoch."""
    return spark.read.schema(EPOCHS).parquet(f"{path}/epochs").select(EPOCH, "packets")


def read_found(spark: SparkSession, path: str, keys: T.StructType) -> DataFrame:
    """``epoch`` and the keys found, of reported epochs; null keys for those without any."""
    schema = T.StructType([T.StructField(EPOCH, T.LongType()), *keys.fields])
    found = spark.read.schema(schema).parquet(f"{path}/found").select(*schema.names)
    return read_report(spark, path).select(EPOCH).join(found, EPOCH, "left")
