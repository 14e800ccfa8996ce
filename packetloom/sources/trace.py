"""Flat packet traces: fixed 36-byte records, read and written in parallel."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from packetloom.schema import ORDER, PACKET_SCHEMA
from packetloom.sources.files import list_files, resolve

# The layout of a record (addresses, seq and ack in network order).
RECORD = np.dtype(
    [
        ("src_addr", ">u4"),
        ("dst_addr", ">u4"),
        ("sport", "<u2"),
        ("dport", "<u2"),
        ("proto", "u1"),
        ("size", "<i4"),
        ("tcp_ack", ">u4"),
        ("tcp_seq", ">u4"),
        ("tcp_flags", "u1"),
        ("pkt_ts", "<f8"),
        ("ip_hdr_size", "u1"),
        ("tcp_hdr_size", "u1"),
    ]
)

PARTITION_RECORDS = 1 << 22
BATCH_RECORDS = 1 << 16

# Arrow types of the packet table, in the order of its schema.
_ARROW = pa.schema(
    [
        ("pkt_no", pa.int64()),
        ("ts", pa.timestamp("us", "UTC")),
        ("pkt_ts", pa.float64()),
        ("src_addr", pa.int64()),
        ("dst_addr", pa.int64()),
        ("sport", pa.int32()),
        ("dport", pa.int32()),
        ("proto", pa.int32()),
        ("size", pa.int32()),
        ("tcp_seq", pa.int64()),
        ("tcp_ack", pa.int64()),
        ("tcp_flags", pa.int32()),
        ("ip_hdr_size", pa.int32()),
        ("tcp_hdr_size", pa.int32()),
    ]
)


def records_to_batch(records: np.ndarray, first_no: int) -> pa.RecordBatch:
    columns = {
        "pkt_no": np.arange(first_no, first_no + len(records), dtype=np.int64),
        "ts": np.rint(records["pkt_ts"] * 1e6).astype(np.int64),
    }
    arrays = []
    for f in _ARROW:
        values = columns.get(f.name)
        if values is None:
            values = records[f.name].astype(f.type.to_pandas_dtype())
        arrays.append(pa.array(values).cast(f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def batch_to_records(batch: pa.RecordBatch) -> np.ndarray:
    records = np.empty(batch.num_rows, RECORD)
    for name in RECORD.names:
        records[name] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
    return records


@dataclass
class RecordRange(InputPartition):
    """A run of records of one file; ``first_no`` counts through all files."""

    path: str
    start: int
    count: int
    first_no: int


class TraceReader(DataSourceReader):
    def __init__(self, path: str, partition_records: int):
        self.path = path
        self.partition_records = partition_records

    def partitions(self) -> list[RecordRange]:
        ranges, first_no = [], 0
        for path, size in list_files(self.path):
            if size % RECORD.itemsize:
                raise ValueError(f"{path}: {size} bytes are not whole {RECORD.itemsize}-byte records")
            total = size // RECORD.itemsize
            for start in range(0, total, self.partition_records):
                count = min(self.partition_records, total - start)
                ranges.append(RecordRange(path, start, count, first_no + start))
            first_no += total
        return ranges

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder has no partitions
            return
        system, path = resolve(partition.path)
        with system.open_input_file(path) as f:
            for start in range(0, partition.count, BATCH_RECORDS):
                count = min(BATCH_RECORDS, partition.count - start)
                at = (partition.start + start) * RECORD.itemsize
                data = f.read_at(count * RECORD.itemsize, at)
                records = np.frombuffer(data, RECORD)
                if len(records) != count:
                    raise ValueError(f"{partition.path}: the file became shorter while it was read")
                yield records_to_batch(records, partition.first_no + start)


@dataclass
class PartFile(WriterCommitMessage):
    staged: str
    final: str


class TraceWriter(DataSourceArrowWriter):
    """Writes each partition to a staged file; commit moves those of the tasks that won."""

    def __init__(self, path: str, overwrite: bool):
        self.path = path.rstrip("/")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        self.overwrite = overwrite
        system, where = resolve(self.path)
        present = system.get_file_info(where).type != fs.FileType.NotFound
        # Name order is packet order, so what is appended comes after all that is there.
        self.old = [path for path, _ in list_files(self.path)] if present else []
        self.batch = 1 + max((int(m[1]) for p in self.old if (m := re.search(r"/part-(\d{6})-\d{6}\.trace$", p))), default=-1)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartFile:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}"
        staged = f"{self.staging}/{name}-{task.taskAttemptId()}"
        system, where = resolve(staged)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(where) as f:
            for batch in iterator:
                f.write(batch_to_records(batch).tobytes())
        return PartFile(staged, f"{self.path}/part-{self.batch:06d}-{task.partitionId():06d}.trace")

    def commit(self, messages: list[PartFile | None]) -> None:
        system, where = resolve(self.path)
        system.create_dir(where, recursive=True)  # no task may have written anything
        for message in messages:
            if message is not None:
                system, staged = resolve(message.staged)
                system.move(staged, resolve(message.final)[1])
        # The old files go last: until then a failure loses nothing.
        for path in self.old if self.overwrite else []:
            system, where = resolve(path)
            system.delete_file(where)
        self._drop_staging()

    def abort(self, messages: list[PartFile | None]) -> None:
        self._drop_staging()

    def _drop_staging(self) -> None:
        system, where = resolve(self.staging)
        if system.get_file_info(where).type == fs.FileType.Directory:
            system.delete_dir(where)


class TraceSource(DataSource):
    """``spark.read.format("packet_trace").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "packet_trace"

    def schema(self):
        return PACKET_SCHEMA

    def reader(self, schema) -> TraceReader:
        return TraceReader(
            self.options["path"], int(self.options.get("partitionRecords", PARTITION_RECORDS))
        )

    def writer(self, schema, overwrite: bool) -> TraceWriter:
        return TraceWriter(self.options["path"], overwrite)


def read_trace(spark: SparkSession, path: str, partition_records: int = PARTITION_RECORDS) -> DataFrame:
    """Packet table of a trace file or a folder of them; ``pkt_no`` follows file order."""
    spark.dataSource.register(TraceSource)
    return spark.read.format("packet_trace").option("partitionRecords", partition_records).load(path)


def write_trace(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write packets as a folder of trace files whose name order is packet order.

    ``append`` adds files after those that are there, so their packets are numbered on.
    """
    df.sparkSession.dataSource.register(TraceSource)
    columns = df.select(*[f.name for f in PACKET_SCHEMA.fields])
    ordered = columns.repartitionByRange(ORDER).sortWithinPartitions(ORDER)
    ordered.write.format("packet_trace").mode(mode).save(path)
