"""Structured Streaming twins of the epochs, and running a stream to its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.functions.scalar import floor_div
from packetloom.schema import EPOCH
from packetloom.sources.shared import shared_dir

WINDOW = "window"

# Fixed value: the state store that timers and large state need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_window(
    df: DataFrame, interval: float, watermark: str, start_us: int = 0, ts: str = "ts"
) -> DataFrame:
    """Add the tumbling ``window`` of each packet, and the watermark that closes it.

    A stream has no known first packet, so the caller gives the anchor. Unlike a
    batch epoch, a window never takes in packets later than the watermark: they
    are dropped, so the caller states the delay to wait for. The last window stays open and gives no result.
    """
    step = round(interval * 1_000_000)
    window = F.window(ts, f"{step} microseconds", startTime=f"{start_us % step} microseconds")
    return df.withWatermark(ts, watermark).withColumn(WINDOW, window)


def window_epoch(interval: float, start_us: int) -> Column:
    """Epoch number of a window column."""
    step = round(interval * 1_000_000)
    return floor_div(F.unix_micros(F.col(WINDOW)["start"]) - start_us, step).alias(EPOCH)


def numbered_epoch(
    df: DataFrame, interval: float, watermark: str, start_us: int = 0, ts: str = "ts"
) -> DataFrame:
    """Epoch numbers on a stream, for stateful operators that keep their own state."""
    step = round(interval * 1_000_000)
    epoch = floor_div(F.unix_micros(F.col(ts)) - start_us, step)
    return df.withWatermark(ts, watermark).withColumn(EPOCH, epoch)


def run_to_end(stream: DataFrame, purpose: str = "stream") -> DataFrame:
    """Process all that is available, append the results to a shared table, read it."""
    spark = stream.sparkSession
    out = shared_dir(spark, purpose)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", shared_dir(spark, f"{purpose}-progress"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_to_end_complete(stream: DataFrame, purpose: str = "stream") -> DataFrame:
    """Process all that is available of an aggregate; its latest state replaces a shared table."""
    spark = stream.sparkSession
    out = shared_dir(spark, purpose)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", shared_dir(spark, f"{purpose}-progress"))
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def require_rocksdb(spark: SparkSession) -> None:
    """Fail early where the session has another state store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, None) != ROCKSDB:
        raise ValueError(f"set {key} to {ROCKSDB}: timers and large state need it")
