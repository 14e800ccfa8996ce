"""Capture files as rows of raw packets.

A capture has no marks to start reading from in the middle, so a large file is
first indexed: each piece of it guesses its first record from a run of plausible
headers and walks to the end of the piece. The guess is right when the walk of
the piece before ends exactly there; pieces where it does not are walked again
from the known start. Only then are the packets read, all pieces in parallel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from packetloom.sources.files import list_files, resolve

# The capture format (public).
FILE_HEADER = 24
RECORD_HEADER = 16
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}
MAX_RECORD = 1 << 18  # no capture tool stores more of one packet

PIECE_BYTES = 128 << 20
GUESS_RUN = 8  # plausible headers in a row that make a guess
BATCH_PACKETS = 8192
READ_BYTES = 4 << 20

RAW_SCHEMA = "file string, pkt_no long, ts timestamp, caplen int, len int, data binary"
_RAW_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("pkt_no", pa.int64()),
        ("ts", pa.timestamp("us", "UTC")),
        ("caplen", pa.int32()),
        ("len", pa.int32()),
        ("data", pa.binary()),
    ]
)
_PIECE = "piece long, path string, start long, stop long, known boolean"
_INDEXED = "piece long, path string, start long, stop long, end long, packets long"


class Capture:
    """Record access to one capture file through a read-ahead buffer."""

    def __init__(self, path: str):
        self.path = path
        system, where = resolve(path)
        self.f: fs.FileSystem = system.open_input_file(where)
        self.size = self.f.size()
        magic = self.f.read_at(4, 0)
        if magic not in MAGICS:
            raise ValueError(f"{path} is not a capture file")
        order, self.ticks = MAGICS[magic]
        self.header = struct.Struct(order + "IIII")
        self.at, self.buffer = 0, b""

    def bytes_at(self, pos: int, n: int) -> bytes:
        if pos < self.at or pos + n > self.at + len(self.buffer):
            self.at = pos
            self.buffer = self.f.read_at(max(n, min(READ_BYTES, self.size - pos)), pos)
        off = pos - self.at
        return self.buffer[off : off + n]

    def record(self, pos: int) -> tuple[int, int, int, int] | None:
        """(seconds, fraction, captured, actual) at a position, None at the end of the file.

        A record cut off by the end of the file is not one; a length that no record
        can have means damage and fails, so that nothing after it is lost in silence.
        """
        head = self.bytes_at(pos, RECORD_HEADER) if pos + RECORD_HEADER <= self.size else b""
        if len(head) < RECORD_HEADER:
            return None
        fields = self.header.unpack(head)
        if fields[2] > MAX_RECORD:
            raise ValueError(f"{self.path}: damaged record at byte {pos}")
        return fields if pos + RECORD_HEADER + fields[2] <= self.size else None

    def _plausible(self, pos: int) -> int | None:
        """Position after a record that could start here."""
        if pos + RECORD_HEADER > self.size:
            return None
        _, fraction, captured, actual = self.header.unpack(self.bytes_at(pos, RECORD_HEADER))
        if captured > min(actual, MAX_RECORD) or not actual or fraction >= 1_000_000 * self.ticks:
            return None
        after = pos + RECORD_HEADER + captured
        return after if after <= self.size else None

    def guess(self, start: int, stop: int) -> int | None:
        """First position from ``start`` on where a run of records could begin."""
        for pos in range(start, stop):
            at = pos
            for _ in range(GUESS_RUN):
                at = self._plausible(at)
                if at is None or at == self.size:
                    break
            if at is not None:
                return pos
        return None

    def walk(self, start: int, stop: int) -> tuple[int, int]:
        """Position after the last record that begins before ``stop``, and their number."""
        pos, n = start, 0
        while pos < stop and (rec := self.record(pos)):
            pos, n = pos + RECORD_HEADER + rec[2], n + 1
        return (pos, n) if pos >= stop else (self.size, n)


def _index_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            capture = Capture(r["path"])
            start = r["start"] if r["known"] else capture.guess(r["start"], r["stop"])
            end, packets = (None, None)
            if start is not None:
                try:
                    end, packets = capture.walk(start, r["stop"])
                except ValueError:
                    if r["known"]:
                        raise  # damage; after a guess it may only have been wrong
            rows.append((r["piece"], r["path"], start, r["stop"], end, packets))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), _index_types())],
            names=["piece", "path", "start", "stop", "end", "packets"],
        )


def _index_types():
    return [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _pieces(files: list[tuple[str, int]], piece_bytes: int) -> list[tuple]:
    pieces = []
    for path, size in files:
        stops = list(range(piece_bytes, size, piece_bytes)) + [size]
        starts = [FILE_HEADER, *stops[:-1]]
        for i, (start, stop) in enumerate(zip(starts, stops)):
            pieces.append((len(pieces), path, start, stop, i == 0))
    return pieces


def _index(spark: SparkSession, pieces: list[tuple]) -> dict[int, tuple]:
    """Index rows by piece number; as with file splits, one small row per piece."""
    rdd = spark.sparkContext.parallelize(pieces, len(pieces))
    found = spark.createDataFrame(rdd, _PIECE).mapInArrow(_index_pieces, _INDEXED)
    return {r["piece"]: (r["start"], r["end"], r["packets"]) for r in found.collect()}


def index_captures(
    spark: SparkSession, files: list[tuple[str, int]], piece_bytes: int = PIECE_BYTES
) -> list[tuple]:
    """(path, start, end, first packet number) of every piece, exact for all of them."""
    pieces = _pieces(files, piece_bytes)
    if not pieces:
        return []
    index = _index(spark, pieces)
    while True:
        wrong = []
        for i, (_, path, _, stop, first) in enumerate(pieces):
            if first:
                end = FILE_HEADER
            elif end is None:
                continue  # waits for the piece before
            start, piece_end, packets = index[i]
            if end >= stop:  # a record covers the whole piece
                index[i] = (end, end, 0)
            elif start != end or piece_end is None:
                wrong.append((i, path, end, stop, True))
                end = None
                continue
            end = index[i][1]
        if not wrong:
            break
        index.update(_index(spark, wrong))
    out, number = [], 0
    for i, (_, path, *_) in enumerate(pieces):
        start, end, packets = index[i]
        if packets:
            out.append((path, start, end, number))
        number += packets
    return out


def _read_pieces(batches: Iterator[pa.RecordBatch], max_caplen: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield from _read_piece(r["path"], r["start"], r["end"], r["first_no"], max_caplen)


def _read_piece(path: str, start: int, end: int, number: int, max_caplen: int | None) -> Iterator[pa.RecordBatch]:
    capture = Capture(path)
    rows, pos = [], start
    while pos < end and (rec := capture.record(pos)):
        seconds, fraction, captured, actual = rec
        caplen = captured if max_caplen is None else min(captured, max_caplen)
        micros = seconds * 1_000_000 + fraction // capture.ticks
        data = capture.bytes_at(pos + RECORD_HEADER, captured)[:caplen]
        rows.append((path, number, micros, caplen, actual, data))
        pos, number = pos + RECORD_HEADER + captured, number + 1
        if len(rows) == BATCH_PACKETS:
            yield _raw_batch(rows)
            rows = []
    if rows:
        yield _raw_batch(rows)


def _raw_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(c, pa.int64()).cast(f.type) if f.name == "ts" else pa.array(c, f.type)
              for c, f in zip(columns, _RAW_ARROW)]
    return pa.RecordBatch.from_arrays(arrays, schema=_RAW_ARROW)


def read_pcap(
    spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES, max_caplen: int | None = None
) -> DataFrame:
    """Raw packets of a capture file, a folder of them or a glob, numbered in file order.

    Columns (file, pkt_no, ts, caplen, len, data); ``max_caplen`` cuts the kept bytes of a
    packet, and ``caplen`` with them. One task per piece of ``piece_bytes``. A damaged
    record fails with its file and place.
    """
    pieces = index_captures(spark, list_files(path), piece_bytes)
    schema = "path string, start long, end long, first_no long"
    if not pieces:
        return spark.createDataFrame([], RAW_SCHEMA)
    rdd = spark.sparkContext.parallelize(pieces, len(pieces))
    return spark.createDataFrame(rdd, schema).mapInArrow(lambda batches: _read_pieces(batches, max_caplen), RAW_SCHEMA)
