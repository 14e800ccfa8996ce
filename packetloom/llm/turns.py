"""Conversation repair: the cheapest edits that make turns alternate.

Roles after repair read ``(s?(ua)+)?`` by their initials. Turns are aligned by
Wagner-Fischer tables to each feasible length of that alternating string. A table holds the
costs of what is left of the turns against what is left of the string, which all lengths
with the same end share; Ukkonen's bands leave out cells that the cheapest alignment so far
(the incumbent) rules out. Of lengths that cost the same, the audits that the tables lead
back to are compared.

A conversation may be too long for a task. Turns are cut into segments where a sorted
partition is cut into blocks of ``SEGMENT`` rows; what a segment costs from each place in
the alternation to each other one is a small matrix, matrices of a conversation are folded
from its end, and each segment is then aligned on its own between the right places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import stored

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SEGMENT_BITS = 11
"""A segment has at most two to this power turns."""

TURNS_A_TASK = 50_000
"""Letters of turns are few bytes and much work; tasks are dealt by turns, not by bytes."""

NEVER = 1 << 40

# Places in the alternation: nothing yet, after a leading system turn, before a user turn, before an assistant turn.
START, LED, USER, ASSISTANT = range(4)
END_COST = (0, 2 * INSERT, 0, INSERT)
END_AUDIT = ("", "II", "", "I")
"""What closes a conversation that stops at each place."""


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` after damage by CRC-32 of ``conv_id:turn`` modulo 20: 0 drops
    a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's.
    Nulls count as one space, but a null turn stays null, and so does a null id."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn)]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        kind.alias("_kind"),
    ).where("_kind <> 0")
    body = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), copies).drop("_copy")


def key_of(conv_id: str = "conv_id") -> Column:
    """A conversation's name in joins; conversations with a null id are one conversation."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def _last() -> Column:
    """The last character of a text that is no white space; empty if none is."""
    return F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)


def classified(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """``conv, turn, role, text, at, fault``: turns in order, ``at`` ascending within a conversation, stored.

    ``fault`` is B, D, T or empty: blank, role and text seen earlier, no sentence end. Equal
    turns stand next to each other; turns that share a number go by role and text. Counts
    and minima that map tasks combine tell what was seen earlier, no window does.
    """
    rows = turns.groupBy(key_of().alias("conv"), "turn", "role", "text").agg(F.count("*").cast("int").alias("_copies"))
    rows = rows.withColumn("_said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = stored(spark, rows, "turns")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("_first")
    seen = rows.where(_last() != "").groupBy("conv", "_said").agg(first, F.count("*").alias("_n")).where("_n > 1").drop("_n")
    seen = stored(spark, seen, "seen")  # its size is known before the join, and a key with many turns can be split there
    later = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    rows = rows.join(seen, ["conv", "_said"], "left").withColumn("_later", later)
    rows = rows.select("conv", "turn", "role", "text", "_later", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    fault = F.when(_last() == "", "B").when(F.col("_later") | (F.col("_copy") > 1), "D").when(~_last().rlike("[.!?]"), "T").otherwise("")
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "_copy"]
    rows = rows.withColumn("fault", fault).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv", "turn", "role", "text", "fault", F.monotonically_increasing_id().alias("at"))
    return stored(spark, rows, "classified")  # ranges are cut anew at every run


def code() -> Column:
    """A letter for the tables: x has to go, else the role's initial or o, upper case if truncated."""
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(F.col("fault").isin("B", "D"), "x").when(F.col("fault") == "T", F.upper(known)).otherwise(known)


class Table:
    """Costs of aligning the turns from each one on with the last ``r`` places of an
    alternating string that ends before a user's (``USER``) or an assistant's turn.

    Within a segment nothing is inserted behind the last turn: that belongs to what follows.
    Row ``i`` holds the cells ``low[i]``.. of the band; others cost more than ``limit`` beyond
    the edits that no alignment avoids.
    """

    def __init__(self, codes: str, end: int, limit: int):
        n = len(codes)
        own = np.frombuffer(codes.encode(), np.uint8)
        fine, cut = np.char.islower(list(codes)) & (own != ord("x")), np.char.isupper(list(codes))
        # Suffix counts. A turn that stays in no band costs DELETE; a truncated one costs at least that.
        n_fine, n_cut = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (fine, cut))
        kept_more = limit // min(INSERT, TRUNCATED - DELETE)  # characters beyond the fine turns: inserted or truncated ones
        self.low = np.maximum(n_fine - limit // DELETE, 0)
        high = n_fine + kept_more
        self.codes, self.end = codes, end
        self.rows: list[np.ndarray] = [np.array([])] * (n + 1)
        last = np.full(int(high[n] - self.low[n]) + 1, NEVER, np.int64)
        last[0] = 0
        self.rows[n] = last
        lowered = codes.lower()
        for i in range(n - 1, -1, -1):
            low, size = int(self.low[i]), int(high[i] - self.low[i]) + 1
            below, start = self.rows[i + 1], int(self.low[i + 1])
            row = np.full(size, NEVER, np.int64)
            a, b = max(low, start), min(low + size, start + len(below))
            if b > a:
                row[a - low : b - low] = below[a - start : b - start] + DELETE
            if codes[i] != "x":
                a, b = max(low, start + 1), min(low + size, start + len(below) + 1)
                if b > a:
                    r = np.arange(a, b)
                    differs = (r % 2 == (0 if end == USER else 1)) != (lowered[i] == "u") if lowered[i] in "ua" else np.ones(b - a, bool)
                    step = below[a - 1 - start : b - 1 - start] + differs * REROLE + (TRUNCATED if cut[i] else 0)
                    row[a - low : b - low] = np.minimum(row[a - low : b - low], step)
            ramp = INSERT * np.arange(size)
            self.rows[i] = np.minimum(np.minimum.accumulate(row - ramp) + ramp, NEVER)

    def expects(self, r: int) -> str:
        """The role that the place ``r`` before the end takes."""
        return "ua"[r % 2] if self.end == USER else "au"[r % 2]

    def cost(self, i: int, r: int) -> int:
        k = r - int(self.low[i])
        return int(self.rows[i][k]) if 0 <= k < len(self.rows[i]) else NEVER

    def lengths(self, i: int, entry: int) -> np.ndarray:
        """Lengths from turn ``i`` on that begin at ``entry``, at least one place long."""
        r = int(self.low[i]) + np.arange(len(self.rows[i]))
        return r[(r > 0) & ((r % 2 == 0) == (entry == self.end))]

    def cheapest(self, i: int, entry: int) -> int:
        r = self.lengths(i, entry)
        return int(self.rows[i][r - int(self.low[i])].min()) if len(r) else NEVER

    def audit(self, i: int, r: int) -> str:
        """The first in ASCII of the cheapest edits from turn ``i`` and ``r`` places before the end."""
        out = []
        n = len(self.codes)
        while i < n or r:
            left = self.cost(i, r)
            if i < n and self.cost(i + 1, r) + DELETE == left:
                out.append("D")
                i += 1
                continue
            if r and self.cost(i, r - 1) + INSERT == left:
                out.append("I")
                r -= 1
                continue
            out.append("K" if self.codes[i].lower() == self.expects(r) else "R")
            i, r = i + 1, r - 1
        return "".join(out)


def unavoidable(codes: str) -> int:
    """Every blank, repeated and truncated turn costs at least its deletion."""
    return DELETE * sum(c == "x" or c.isupper() for c in codes)


@lru_cache(1)
def tables(codes: str) -> tuple[Table, Table]:
    """Tables for both ends, with bands that hold every cheapest alignment and all that cost the same.

    A narrow band gives alignments, the cheapest of them is the incumbent. What is best from
    here to there costs at most two insertions more, which lead to any place from any other;
    so a band that reaches this far is proven. Else it is the next one, or one of twice the
    last reach if that is narrower.
    """
    least, limit = unavoidable(codes), 16
    while True:
        both = Table(codes, USER, limit), Table(codes, ASSISTANT, limit)
        incumbent = min(t.cheapest(0, e) for t in both for e in (USER, ASSISTANT)) - least
        if not codes or incumbent + 2 * INSERT <= limit:
            return both
        limit = min(2 * limit, incumbent + 2 * INSERT)


def leads(codes: str) -> Iterator[tuple[int, int, str]]:
    """Turns that can be the leading system turn, with the cost and the audit up to it."""
    for k, c in enumerate(codes):
        if c in "sS":
            yield k, DELETE * k + (TRUNCATED if c == "S" else 0), "D" * k + "K"


def options(codes: str, entry: int) -> Iterator[tuple[int, int, Table | None, int, str]]:
    """(cost, exit, table, turn, audit so far) of every way to begin at ``entry`` that a table
    completes over its cheapest lengths; without a table the audit is whole."""
    n = len(codes)
    yield DELETE * n, entry, None, n, "D" * n
    begin = USER if entry in (START, LED) else entry
    for t in tables(codes):
        yield t.cheapest(0, begin), t.end, t, 0, ""
    if entry == START:
        for k, cost, audit in leads(codes):
            yield cost + DELETE * (n - k - 1), LED, None, n, audit + "D" * (n - k - 1)
            for t in tables(codes):
                yield cost + t.cheapest(k + 1, USER), t.end, t, k + 1, audit


@lru_cache(4096)
def price(codes: str) -> list[int]:
    """Costs from each place to each other one, row by row."""
    out = [NEVER] * 16
    for entry in range(4):
        for cost, to, *_ in options(codes, entry):
            out[4 * entry + to] = min(out[4 * entry + to], cost)
    return out


@lru_cache(4096)
def align(codes: str, entry: int, to_go: tuple[int, ...], tails: tuple[str, ...] = ("",) * 4) -> tuple[int, int, str]:
    """(cost with what is to go, exit, audit) of the cheapest edits from ``entry``, the first in ASCII.

    Every feasible length that reaches the least cost is led back through its table and the
    audits, each with its exit's tail, are compared.
    """
    ways = list(options(codes, entry))
    least = min(cost + to_go[to] for cost, to, *_ in ways)
    found = set()
    for cost, to, table, i, audit in ways:
        if cost + to_go[to] != least:
            continue
        if table is None:
            found.add((audit + tails[to], to))
            continue
        begin = USER if entry in (START, LED) else entry
        r = table.lengths(i, begin)
        best = table.cheapest(i, begin)
        found |= {(audit + table.audit(i, int(x)) + tails[to], to) for x in r[table.rows[i][r - int(table.low[i])] == best]}
    audit, to = min(found)
    return least, to, audit


def illegal(initials: str) -> int:
    """Neighbours that are no system and user, user and assistant or assistant and user turn."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def segments(turns: DataFrame, tasks: int) -> DataFrame:
    """``conv, seg, codes, initials``, a letter for each turn of a segment in order."""
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    own = F.sort_array(F.collect_list(F.struct("at", code().alias("code"), known.alias("initial"))))
    turns = turns.select("conv", "at", "role", "fault", F.shiftright("at", SEGMENT_BITS).alias("seg"))
    each = turns.repartition(tasks, "conv", "seg").groupBy("conv", "seg").agg(own.alias("own"))
    return each.select("conv", "seg", *[F.array_join(F.col(f"own.{c}"), "").alias(f"{c}s") for c in ("code", "initial")])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    yield from batch.to_pylist()


def priced(segs: DataFrame) -> DataFrame:
    """Segments with their matrix of costs and their illegal neighbours."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs = [price(c) for c in b.column("codes").to_pylist()]
            wrong = [illegal(c) for c in b.column("initials").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(wrong, pa.int64())], names=[*b.schema.names, "costs", "wrong"])

    return segs.mapInArrow(work, "conv string, seg long, codes string, initials string, costs array<long>, wrong long")


def with_costs_to_go(segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per segment ``conv, seg, to_go, first, last``, and per conversation ``conv, cost, illegal``.

    A segment comes with a few numbers here; a conversation of a billion turns has some half
    a million of them.
    """
    ends = [F.substring("initials", 1, 1).alias("first"), F.substring("initials", -1, 1).alias("last")]
    own = F.sort_array(F.collect_list(F.struct("seg", "costs", "wrong", *ends))).alias("own")
    chains = segs.groupBy("conv").agg(own)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in _rows(b):
                own, to_go = r["own"], list(END_COST)
                steps = []
                for x in reversed(own):
                    steps.append({"seg": x["seg"], "to_go": to_go, "first": x is own[0], "last": x is own[-1]})
                    to_go = [min(c + g for c, g in zip(x["costs"][4 * e : 4 * e + 4], to_go, strict=True)) for e in range(4)]
                wrong = sum(x["wrong"] for x in own) + sum(illegal(x["last"] + y["first"]) for x, y in zip(own, own[1:]))
                out.append({"conv": r["conv"], "cost": to_go[START], "illegal": wrong, "steps": steps})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    step = pa.struct([("seg", pa.int64()), ("to_go", pa.list_(pa.int64())), ("first", pa.bool_()), ("last", pa.bool_())])
    shape = pa.schema([("conv", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("steps", pa.list_(step))])
    found = chains.mapInArrow(work, "conv string, cost long, illegal long, steps array<struct<seg: long, to_go: array<long>, first: boolean, last: boolean>>")
    return found.select("conv", F.explode("steps").alias("x")).select("conv", "x.*"), found.select("conv", "cost", "illegal")


def aligned(segs: DataFrame, steps: DataFrame, tasks: int) -> DataFrame:
    """``conv, seg, exits, audits``: for each place to enter a segment at, where its edits lead
    and what they are. A conversation's first segment is entered at the start only."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in _rows(b):
                tails = END_AUDIT if r["last"] else ("",) * 4
                ways = [align(r["codes"], e, tuple(r["to_go"]), tails)[1:] for e in range(1 if r["first"] else 4)]
                out.append({"conv": r["conv"], "seg": r["seg"], "exits": [w[0] for w in ways], "audits": [w[1] for w in ways]})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("exits", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))])
    both = segs.select("conv", "seg", "codes").repartition(tasks, "conv", "seg").join(steps, ["conv", "seg"])
    return both.mapInArrow(work, "conv string, seg long, exits array<int>, audits array<string>")


def audits(ways: DataFrame) -> DataFrame:
    """``conv, seg, audit``: each segment's edits from where the segments before it lead."""
    chains = ways.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", "exits"))).alias("own"))
    steps = F.aggregate(
        "own",
        F.struct(F.lit(START).alias("at"), F.array().cast("array<struct<seg: long, entry: int>>").alias("steps")),
        lambda done, x: F.struct(
            F.get(x["exits"], done["at"]).alias("at"), F.concat(done["steps"], F.array(F.struct(x["seg"].alias("seg"), done["at"].alias("entry")))).alias("steps")
        ),
        lambda done: done["steps"],
    )
    entries = chains.select("conv", F.explode(steps).alias("x")).select("conv", "x.*")
    return ways.join(entries, ["conv", "seg"]).select("conv", "seg", F.get("audits", F.col("entry")).alias("audit"))


class Repair:
    """The repaired turns of one conversation, from its audits and turns in order."""

    def __init__(self):
        self.digest, self.empty, self.audit = hashlib.sha256(), True, []
        self.place, self.left = START, iter("")

    def _put(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def _next(self) -> str:
        """The role that comes now."""
        role = "assistant" if self.place == ASSISTANT else "user"
        self.place = ASSISTANT if role == "user" else USER
        return role

    def segment(self, audit: str) -> None:
        self.close()
        self.audit.append(audit)
        self.left = iter(audit)

    def close(self) -> None:
        """Insertions behind the last turn."""
        for _ in self.left:
            self._put(self._next(), "")

    def turn(self, role: str, text: str) -> None:
        for edit in self.left:
            if edit == "D":
                return
            if edit == "K" and self.place == START and role[:1] == "s":
                self.place = LED
                return self._put(role, text)
            wanted = self._next()
            if edit != "I":
                return self._put(role if edit == "K" else wanted, text)
            self._put(wanted, "")


def repaired(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """``conv, audit, repaired_sha256``, from one pass over the turns in order.

    Nothing but the audit is held; a SHA-256 of a whole conversation has to see it in turn.
    """
    none = F.lit(None).cast("string")
    seg = F.shiftright("at", SEGMENT_BITS).alias("seg")
    rows = turns.select("conv", seg, "at", "role", "text", none.alias("audit"))
    rows = rows.unionByName(pieces.select("conv", "seg", F.lit(-1).cast("long").alias("at"), none.alias("role"), none.alias("text"), "audit"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "seg", "at")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own = None, None

        def done() -> dict:
            own.close()
            return {"conv": conv, "audit": "".join(own.audit), "repaired_sha256": own.digest.hexdigest()}

        for b in batches:
            out = []
            for name, role, text, audit in zip(*[b.column(c).to_pylist() for c in ("conv", "role", "text", "audit")], strict=True):
                if own is None or name != conv:
                    if own is not None:
                        out.append(done())
                    conv, own = name, Repair()
                if audit is not None:
                    own.segment(audit)
                else:
                    own.turn(role, text)
            yield pa.RecordBatch.from_pylist(out, schema=shape)
        if own is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=shape)

    shape = pa.schema([("conv", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return rows.mapInArrow(work, "conv string, audit string, repaired_sha256 string")


def repair(spark: SparkSession, turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``turns`` (and of ``ids``, if given): ``conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``turns`` has ``conv_id, turn, role, text``; null roles and texts count as one space.
    ``audit`` has a letter per edit (Keep, Rerole, Delete, Insert) in order; of those that
    cost least it is the first in ASCII. A conversation without turns has zeros, an empty
    audit and the hash of an empty text. Null ids are one conversation, null turn numbers
    come first and count in no gap.
    """
    ids = turns if ids is None else ids
    filled = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = classified(spark, filled)
    numbers = rows.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == c).alias(c) for c in "BDT"])
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    stats = numbers.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(c).alias(n) for c, n in zip("BDT", ("blank", "duplicate", "truncated"), strict=True)])
    tasks = rows.count() // TURNS_A_TASK + 1
    segs = stored(spark, priced(segments(rows, tasks)), "segments")
    steps, costs = with_costs_to_go(segs)
    ways = stored(spark, aligned(segs, steps, tasks), "ways")
    found = repaired(rows, audits(ways))
    names = ids.select("conv_id").distinct().withColumn("conv", key_of())
    whole = names.join(stats, "conv", "left").join(costs, "conv", "left").join(found, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
