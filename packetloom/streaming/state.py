"""Register functions on streams: the fold of the batch operator, in packet order.

Micro-batches bring the packets of a key in no order, and a packet may come a batch after
its successors. So packets wait in the state store until the watermark has passed them,
and are folded then by their numbers.

A round trip to the state store costs more than the fold of a key with a few packets. So the
keys of an epoch are dealt into buckets, and a bucket is what the state store knows: runs of
waiting packets of all its keys, and their registers in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packetloom.operators.folds import KEY_NULLS, Fold, KeyedFold, joined, without_nulls
from packetloom.schema import EPOCH, ORDER, column_names
from packetloom.streaming.windows import require_rocksdb

PIECE_ROWS = 1 << 14

BUCKETS = 128
"""Buckets that the keys of an epoch are dealt into; fixed for the life of a stream."""

REGISTERS = 1 << 16
"""Keys whose registers are stored as one value."""

# A run of waiting packets in order: its first packet number and its own number name it,
# and the time of its earliest packet says when it is needed.
_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "run", "earliest")])
_PACKETS = T.StructType([T.StructField("packets", T.BinaryType())])
_BLOCK = T.StructType([T.StructField("block", T.LongType())])
_COUNT = T.StructType([T.StructField("runs", T.LongType())])

# Rows come to a processor as named tuples, which rename columns that begin with "_".
_TIME = "packet_time_us"
_BUCKET = "packet_bucket"


def _stored(batch: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write(batch)
    return sink.getvalue().to_pybytes()


def _packed(packets: pd.DataFrame) -> bytes:
    return _stored(pa.RecordBatch.from_pandas(packets, preserve_index=False))


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def merged_runs(
    runs: list[tuple], load: Callable[[tuple], pd.DataFrame], order: str
) -> Iterator[pd.DataFrame]:
    """Frames in order of ``order`` out of sorted runs named (first number, run number, ...).

    A run is loaded when its first packet is next, so only runs that overlap are held at once.
    Sending anything ends the merge and gives the packets that are loaded but not yielded.
    """
    heapq.heapify(runs)
    held = None
    while runs:
        loaded = load(heapq.heappop(runs))
        if held is not None and len(held):
            loaded = pd.concat([held, loaded], ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        ready = int(loaded[order].searchsorted(runs[0][0])) if runs else len(loaded)
        held = loaded.iloc[ready:]
        if ready and (yield loaded.iloc[:ready].reset_index(drop=True)):
            yield held
            return


class FoldProcessor(StatefulProcessor):
    """Registers and waiting packets of one (epoch, bucket of keys), dropped when the epoch is closed."""

    def __init__(self, keyed: KeyedFold, registers: T.StructType, order: str, start_us: int, step_us: int):
        self.keyed = keyed
        self.table = to_arrow_schema(registers)
        self.order = order
        self.start_us = start_us
        self.step_us = step_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.registers = handle.getMapState("registers", _BLOCK, _PACKETS)
        self.count = handle.getValueState("count", _COUNT)
        self.waiting = handle.getMapState("waiting", _RUN, _PACKETS)

    def end_us(self, key: tuple) -> int:
        return self.start_us + (key[0] + 1) * self.step_us

    def at_watermark(self, ms: int) -> None:
        """Ask for a call once the watermark is at ``ms``: timers expire when it is above them."""
        self.handle.registerTimer(ms - 1)

    def keep(self, packets: pd.DataFrame, run: int) -> int:
        """Store packets in order as runs from number ``run`` on; the next free number."""
        for at in range(0, len(packets), self.keyed.rows):
            part = packets.iloc[at : at + self.keyed.rows]
            self.waiting.updateValue((int(part[self.order].iloc[0]), run, int(part[_TIME].min())), (_packed(part),))
            run += 1
        return run

    def known(self) -> dict[tuple, tuple]:
        """Registers by name of the key."""
        n = 1 + len(self.keyed.group)
        out = {}
        for (data,) in self.registers.values():
            rows = zip(*[c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns], strict=True)
            out.update((r[:n], r[n:]) for r in rows)
        return out

    def remember(self, states: dict[tuple, tuple]) -> None:
        rows = [(*name, *state) for name, state in states.items()]
        for at in range(0, len(rows), REGISTERS):
            columns = zip(*rows[at : at + REGISTERS], strict=True)
            table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.table, strict=True)], schema=self.table)
            self.registers.updateValue((at // REGISTERS,), (_stored(table),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.count.exists():
            run = self.count.get()[0]
        else:
            run = 0
            self.at_watermark(-(-self.end_us(key) // 1000))
        earliest = None
        for frame in rows:
            if len(frame):
                run = self.keep(frame.sort_values(self.order, ignore_index=True), run)
                first = int(frame[_TIME].min())
                earliest = first if earliest is None else min(earliest, first)
        self.count.update((run,))
        if earliest is not None:
            self.at_watermark(earliest // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.count.exists():
            return
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        passed, closing = watermark + 999, watermark >= self.end_us(key)
        run, keyed = self.count.get()[0], self.keyed
        due = 0  # loaded packets that the watermark has passed, not yet seen below

        def load(name: tuple) -> pd.DataFrame:
            nonlocal due
            packets = _unpacked(self.waiting.getValue(name)[0])
            self.waiting.removeKey(name)
            due += int((packets[_TIME] <= passed).sum())
            return packets

        names = [tuple(name) for name in self.waiting.keys()]
        earliest = [name[2] for name in names if name[2] > passed]
        states: dict[tuple, tuple] | None = None
        blocked: set[tuple] = set()
        if len(earliest) < len(names):
            states = self.known()
            merge = merged_runs(names, load, self.order)
            for frame in merge:
                packets = keyed.sorted(frame, self.order)
                due -= int((packets[_TIME] <= passed).sum())
                first = keyed.starts(packets)
                own = keyed.names(packets, first)
                ahead = (packets[_TIME] > passed).to_numpy()
                if ahead.any() or blocked:
                    # A packet waits for those of its key with smaller numbers.
                    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(packets))))
                    ahead |= np.array([name in blocked for name in own], bool)[of]
                    ahead = pd.Series(ahead).groupby(of).cummax().to_numpy(bool)
                    blocked.update(own[i] for i in np.unique(of[ahead]).tolist())
                    wait = packets[ahead].sort_values(self.order, kind="stable", ignore_index=True)
                    earliest += [int(wait[_TIME].min())] if len(wait) else []
                    run = self.keep(wait, run)
                    packets = packets[~ahead].reset_index(drop=True)
                    first = keyed.starts(packets)
                    own = keyed.names(packets, first)
                out, after = keyed.fold(packets, first, own, [states.get(name, keyed.initial) for name in own])
                states.update(zip(own, after, strict=True))
                if keyed.on_close is None:
                    yield from joined(out)
                if not due and not any(name[2] <= passed for name in names):
                    # Only loaded runs are put back; the others have not been touched.
                    rest = merge.send(True)
                    earliest += [int(rest[_TIME].min())] if len(rest) else []
                    run = self.keep(rest, run)
                    break
        if closing:
            if keyed.on_close is not None:
                states = self.known() if states is None else states
                yield from joined(keyed.closed(list(states), list(states.values())))
            self.registers.clear()
            self.waiting.clear()
            self.count.clear()
            return
        if states is not None:
            self.remember(states)
        self.count.update((run,))
        if earliest:
            self.at_watermark(max(min(earliest), passed + 1) // 1000)

    def close(self) -> None:
        pass


def stateful_fold_stream(
    df: DataFrame,
    keys: Sequence[str],
    fn: Fold,
    initial: tuple,
    state_schema: T.StructType,
    out_schema: T.StructType,
    interval: float,
    start_us: int = 0,
    on_close: Callable[[tuple, tuple], pd.DataFrame] | None = None,
    by: str = EPOCH,
    order: str = ORDER,
    ts: str = "ts",
    rows: int = PIECE_ROWS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming form of ``stateful_fold`` on packets with a watermark on ``ts`` and an epoch.

    Packets wait until the watermark has passed them and all of their key with smaller
    numbers that came, so results lag by the delay that the caller gave, and packets that
    come in the wrong order within it are folded in the right one. Spark keeps watermarks in
    whole milliseconds, so a delay a millisecond above the longest disorder is exact. Behind
    the delay packets are dropped, as everywhere on streams; packets without a time are in
    no epoch. No call sees more than ``rows`` packets of a key (a ``GroupedFold`` gets many
    keys). The keys of an epoch share ``buckets`` buckets: a bucket's waiting packets are read
    in runs of ``rows``, those that overlap at once, and the registers of its keys when some
    of its packets are folded. With ``on_close`` the fold's own rows are dropped and one
    result per key is emitted when its epoch is over.
    """
    require_rocksdb(df.sparkSession)
    group = [by, *column_names(keys)]
    keyed = KeyedFold(fn, on_close, group, df.schema, initial, rows)
    names = T.StructType([T.StructField(KEY_NULLS, T.StringType()), *[df.schema[g] for g in group]])
    registers = T.StructType([*names.fields, *[T.StructField(f"register_{f.name}", f.dataType) for f in state_schema.fields]])
    timed = df.where(F.col(ts).isNotNull())
    filled = without_nulls(timed, group, order).withColumn(_TIME, F.unix_micros(F.col(ts).cast("timestamp")))
    bucket = F.pmod(F.xxhash64(KEY_NULLS, *group), F.lit(buckets)).cast("int")
    return filled.withColumn(_BUCKET, bucket).groupBy(by, _BUCKET).transformWithStateInPandas(
        FoldProcessor(keyed, registers, order, start_us, round(interval * 1_000_000)), out_schema, outputMode="Append", timeMode="EventTime"
    )
