"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import stored

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 64
"""Cost of a sequence besides its length: what opening one more is worth avoiding."""

SHARD_PIECES = 10_000
"""Pieces that one task packs together."""


def pack(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and the final capacity of each bin.

    Pieces go in falling order of size (ties in the given order) into the open bin with the
    least room that suffices (ties: the oldest). If none does, a bin opens whose capacity
    costs least (length and ``overhead``) per token that it can still be filled with, given
    what remains to be packed; of equal costs the larger. At the end each bin shrinks to the
    smallest permitted length that holds it.
    """
    caps = sorted(capacities)
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    rooms: list[int] = []  # rooms that some open bin has, in order
    by_room: dict[int, list[int]] = {}
    left = int(sizes.sum())

    def put(b: int, room: int) -> None:
        if room:
            if not by_room.get(room):
                by_room[room] = []
                insort(rooms, room)
            heappush(by_room[room], b)

    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = heappop(by_room[room])
            if not by_room[room]:
                rooms.pop(at)
        else:
            room = min((c for c in caps if c >= size), key=lambda c: ((c + overhead) / min(c, left), -c))
            b = len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        put(b, room - size)
        left -= size
    return bins, offsets, [caps[bisect_left(caps, n)] for n in filled]


def best_fit(
    docs: DataFrame,
    length: Column,
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = OVERHEAD,
    shard_pieces: int = SHARD_PIECES,
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, size, bin_id, capacity, offset``.

    ``length`` is a document's number of tokens. A document longer than the largest
    capacity is cut into pieces of it and a rest. Pieces are dealt evenly over as many
    shards as their number asks for, by their place in the input, whatever their ids, and
    every shard is packed on its own. A document without tokens (null or empty) is one
    piece of size 0 in no bin: ``bin_id``, ``capacity`` and ``offset`` are null.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    largest = max(capacities)
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("length"))
    # Stored, lengths are counted once and every row has a place that a second reading finds again.
    sized = stored(docs.sparkSession, sized, "lengths")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("length") / largest) - 1))))
    pieces = cut.select("doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("length") - F.col("piece") * largest).alias("size"))
    n = sized.agg(F.sum(F.ceil(F.col("length") / largest))).first()[0] or 0
    shards = max(1, -(-int(n) // shard_pieces))
    # Neighbours in the input go to different shards.
    place = F.monotonically_increasing_id()
    dealt = pieces.withColumn("shard", F.pmod(place + F.shiftright(place, 33) * 7919, F.lit(shards)).cast("long"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; one shard is held at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and held[-1].column("shard")[0].as_py() != shard[lo]:
                    yield close(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield close(held)

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        sizes = np.asarray(t.column("size"))
        bins, offsets, caps = pack(sizes[sizes > 0], capacities, overhead)
        has = sizes > 0
        shard = held[0].column("shard")[0].as_py()

        def full(values: np.ndarray) -> pa.Array:
            out = np.zeros(len(sizes), np.int64)
            out[has] = values
            return pa.array(out, mask=~has)

        ids = t.column("doc_id").combine_chunks()
        columns = [ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, *(pa.array(np.asarray(t.column(c))) for c in ("piece", "start", "size"))]
        columns += [full((shard << 32) + bins), full(np.array(caps, np.int64)[bins]), full(offsets)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "size", "bin_id", "capacity", "offset"])

    kind = docs.schema[doc_id].dataType.simpleString()
    placed = dealt.repartition("shard").sortWithinPartitions("shard", F.xxhash64("doc_id", "piece"), "doc_id", "piece", "size")
    return placed.mapInArrow(work, f"doc_id {kind}, piece long, start long, size long, bin_id long, capacity long, offset long")


def n_words(text: Column) -> Column:
    """Tokens of a text as its runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0))
