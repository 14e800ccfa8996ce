"""Register functions over frames that hold the packets of many keys.

A call per key costs about a millisecond of Python, whatever it does, and most keys have a
few packets only. So a fold may come with a form for many keys at once; keys with a null
somewhere, and folds without such a form, are called one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# fn(key, packets in order, state) -> (output rows, new state)
Fold = Callable[[tuple, pd.DataFrame, tuple], tuple[pd.DataFrame, tuple]]

# Which columns of a key, and which others, are null in a packet: one digit a column.
KEY_NULLS, OTHER_NULLS = "packet_key_nulls", "packet_nulls"

_MOST = {T.LongType(): (1 << 63) - 1, T.IntegerType(): (1 << 31) - 1, T.ShortType(): (1 << 15) - 1, T.ByteType(): 127}


@dataclass(frozen=True)
class GroupedFold:
    """A ``Fold`` with a form for many keys: the same results, no matter which is called.

    ``many(packets, first, registers)`` gets packets without nulls, sorted by key and order,
    the first row of each key, and one array per register; it returns the outputs and the
    new arrays.
    """

    one: Fold
    many: Callable[[pd.DataFrame, np.ndarray, list[np.ndarray]], tuple[pd.DataFrame, list[np.ndarray]]]

    def __call__(self, key: tuple, packets: pd.DataFrame, before: tuple) -> tuple[pd.DataFrame, tuple]:
        return self.one(key, packets, before)


@dataclass(frozen=True)
class GroupedClose:
    """What is said per closed key, with a form for many keys: an array per key column and register."""

    one: Callable[[tuple, tuple], pd.DataFrame]
    many: Callable[[list[np.ndarray], list[np.ndarray]], pd.DataFrame]

    def __call__(self, key: tuple, registers: tuple) -> pd.DataFrame:
        return self.one(key, registers)


def without_nulls(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Whole numbers and booleans filled in where they are null, and what was.

    A pandas column holds them as floats as soon as one is null, those of other keys as well.
    Packets without a number come last.
    """
    exact = [f for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.BooleanType))]

    def nulls(fields: list[T.StructField]):
        if not fields:
            return F.lit("")
        digits = F.concat(*[F.when(F.col(f.name).isNull(), "1").otherwise("0") for f in fields])
        return F.when(digits.contains("1"), digits).otherwise("")

    of_keys, others = [f for f in exact if f.name in keys], [f for f in exact if f.name not in keys]
    masks = {KEY_NULLS: nulls(of_keys), OTHER_NULLS: nulls(others)}
    filled = {
        f.name: F.coalesce(F.col(f.name), F.lit(_MOST[f.dataType] if f.name == order else 0).cast(f.dataType))
        if isinstance(f.dataType, T.IntegralType)
        else F.coalesce(F.col(f.name), F.lit(False))
        for f in exact
    }
    return df.withColumns(masks).withColumns(filled)


class KeyedFold:
    """A fold over frames made by ``without_nulls``; no call sees more than ``rows`` packets of a key.

    ``group`` and ``columns`` are the key's columns and all of the packet, ``exact`` those
    that ``without_nulls`` fills.
    """

    def __init__(self, fn: Fold, on_close: Callable | None, group: Sequence[str], schema: T.StructType, initial: tuple, rows: int):
        self.fn, self.on_close, self.group, self.initial, self.rows = fn, on_close, list(group), initial, rows
        self.columns = schema.names
        exact = [f for f in schema.fields if isinstance(f.dataType, (T.IntegralType, T.BooleanType))]
        self.of_keys = [f.name for f in exact if f.name in self.group]
        self.others = [f.name for f in exact if f.name not in self.group]
        self.booleans = {f.name for f in exact if isinstance(f.dataType, T.BooleanType)}

    def sorted(self, packets: pd.DataFrame, order: str) -> pd.DataFrame:
        return packets.sort_values([KEY_NULLS, *self.group, order], kind="stable", ignore_index=True)

    def starts(self, packets: pd.DataFrame) -> np.ndarray:
        """First row of each key in sorted packets."""
        new = np.zeros(len(packets), bool)
        new[:1] = True
        for c in (KEY_NULLS, *self.group):
            v, null = packets[c].to_numpy(), packets[c].isna().to_numpy()
            new[1:] |= (v[1:] != v[:-1]).astype(bool) & ~(null[1:] & null[:-1])
        return np.flatnonzero(new)

    def names(self, packets: pd.DataFrame, first: np.ndarray) -> list[tuple]:
        """A name for each key: its values and which of them are null."""
        at = packets.iloc[first]
        columns = [at[c].astype(object).where(at[c].notna(), None).tolist() for c in (KEY_NULLS, *self.group)]
        return list(zip(*columns, strict=True))

    def key(self, name: tuple) -> tuple:
        gone = {c for c, null in zip(self.of_keys, name[0]) if null == "1"}
        return tuple(None if c in gone else v for c, v in zip(self.group, name[1:], strict=True))

    def _restored(self, packets: pd.DataFrame) -> pd.DataFrame:
        """The packets of one key with their nulls."""
        out = packets[self.columns].reset_index(drop=True)
        for mask, names in ((KEY_NULLS, self.of_keys), (OTHER_NULLS, self.others)):
            if not (packets[mask] != "").any():
                continue
            for i, c in enumerate(names):
                null = (packets[mask].str.get(i) == "1").to_numpy(bool)
                if null.any():
                    out[c] = out[c].astype(object if c in self.booleans else float).mask(null, None if c in self.booleans else np.nan)
        return out

    def _one(self, name: tuple, packets: pd.DataFrame, state: tuple) -> tuple[list[pd.DataFrame], tuple]:
        own, key, out = self._restored(packets), self.key(name), []
        for at in range(0, len(own), self.rows):
            made, state = self.fn(key, own.iloc[at : at + self.rows].reset_index(drop=True), state)
            out.append(made)
        return out, tuple(state)

    def fold(self, packets: pd.DataFrame, first: np.ndarray, names: list[tuple], states: list[tuple]) -> tuple[list[pd.DataFrame], list[tuple]]:
        """Outputs and new registers of the keys of sorted packets."""
        states = list(states)
        sizes = np.diff(np.append(first, len(packets)))
        plain = np.zeros(len(first), bool)
        if isinstance(self.fn, GroupedFold) and len(first):
            null = packets[OTHER_NULLS].ne("").to_numpy() | packets[KEY_NULLS].ne("").to_numpy()
            null |= packets[self.columns].isna().to_numpy().any(axis=1)
            plain = ~np.logical_or.reduceat(null, first)
            plain &= np.array([None not in s for s in states], bool)
        out = []
        for i in np.flatnonzero(~plain).tolist():
            made, states[i] = self._one(names[i], packets.iloc[first[i] : first[i] + sizes[i]], states[i])
            out += [m.astype(object) for m in made if len(m)]
        if plain.any():
            which = np.flatnonzero(plain)
            mine = packets if plain.all() else packets[np.repeat(plain, sizes)]
            made, after = self._many(mine[self.columns].reset_index(drop=True), sizes[which], [np.array(r) for r in zip(*[states[i] for i in which])])
            out += [m for m in made if len(m)]
            for i, s in zip(which.tolist(), zip(*[r.tolist() for r in after], strict=True), strict=True):
                states[i] = s
        return out, states

    def _many(self, packets: pd.DataFrame, sizes: np.ndarray, registers: list[np.ndarray]) -> tuple[list[pd.DataFrame], list[np.ndarray]]:
        """Calls for many keys: the first ``rows`` packets of each, then the next ones."""
        first = np.cumsum(sizes) - sizes
        if sizes.max() <= self.rows:
            made, after = self.fn.many(packets, first, registers)
            return [made], after
        call = (np.arange(len(packets)) - np.repeat(first, sizes)) // self.rows
        at = np.argsort(call, kind="stable")
        ends = np.searchsorted(call[at], np.arange(call.max() + 2))
        out, registers = [], [r.copy() for r in registers]
        for n in range(int(call.max()) + 1):
            now = np.flatnonzero(sizes > n * self.rows)
            held = np.minimum(sizes[now] - n * self.rows, self.rows)
            made, after = self.fn.many(packets.iloc[at[ends[n] : ends[n + 1]]].reset_index(drop=True), np.cumsum(held) - held, [r[now] for r in registers])
            out.append(made)
            for r, a in zip(registers, after, strict=True):
                r[now] = a
        return out, registers

    def closed(self, names: list[tuple], states: list[tuple]) -> list[pd.DataFrame]:
        """What ``on_close`` says of these keys."""
        many = isinstance(self.on_close, GroupedClose)
        plain = [many and not n[0] and None not in n and None not in s for n, s in zip(names, states, strict=True)]
        out = [self.on_close(self.key(n), s) for n, s, p in zip(names, states, plain, strict=True) if not p]
        out = [o.astype(object) for o in out if len(o)]
        own = [(n, s) for n, s, p in zip(names, states, plain, strict=True) if p]
        if own:
            keys = [np.array(c) for c in zip(*[n[1:] for n, _ in own], strict=True)]
            out.append(self.on_close.many(keys, [np.array(r) for r in zip(*[s for _, s in own], strict=True)]))
        return out

    def over_sorted(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Results of frames in the order of keys and packets; the last key of a frame may go on in the next."""
        last, state = None, self.initial
        for frame in frames:
            if not len(frame):
                continue
            frame = frame.reset_index(drop=True)
            first = self.starts(frame)
            names = self.names(frame, first)
            states = [self.initial] * len(names)
            done = []
            if last is not None:
                if last == names[0]:
                    states[0] = state
                else:
                    done = [(last, state)]
            out, states = self.fold(frame, first, names, states)
            done += zip(names[:-1], states[:-1], strict=True)
            last, state = names[-1], states[-1]
            yield from joined(out if self.on_close is None else self.closed(*map(list, zip(*done, strict=True))) if done else [])
        if last is not None and self.on_close is not None:
            yield from joined(self.closed([last], [state]))


def joined(frames: list[pd.DataFrame]) -> list[pd.DataFrame]:
    """The rows of ``frames`` as one frame, or none."""
    if not frames:
        return []
    return [frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)]
