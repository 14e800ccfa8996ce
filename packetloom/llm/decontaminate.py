"""Benchmark decontamination by a stored positional index over the training documents.

The index is cut into blocks of whole documents. Inside a block every word has one
position, with an unused position between documents, so that no phrase can cross from
one document to the next. A row of the index holds all positions of one term in one
block, delta-coded; a frequent term has a bounded row in each block and never a long
list anywhere. Searching takes a block at a time: phrases are looked up by their rarest
term, so a block meets only those whose rarest term it holds, and the offset-adjusted
positions of the other terms are intersected from there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import row_key, slices, stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

BLOCK_WORDS = 1 << 20
"""Words in a block of the index (a longer document has a block of its own)."""

PHRASES_AT_ONCE = 200_000
"""Phrases sent to all executors together, about 60 bytes each; more are searched in turns."""

VOCABULARY = 1_000_000
"""Up to so many different words in the phrases, only these words are indexed."""


def words(text: str | None) -> list[str]:
    """Runs of ASCII letters, digits and non-ASCII characters; A-Z in lower case."""
    return WORD.findall(text.translate(LOWER)) if text else []


def phrases(items: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per different window of ``window`` item words: ``words``, ``items`` (ids as text).

    An item of fewer words, but not none, is one phrase. Null and empty items have none.
    A phrase lists the items it stands in, so its row is bounded by the test set.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, found = [], []
            for item, body in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words(body)
                runs = {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else ()
                found.extend(map(list, runs))
                ids.extend([item] * len(runs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.string())), pa.array(ids, pa.string())], names=["words", "item"]
            )

    cut_items = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    rows = cut_items.mapInArrow(cut, "words array<string>, item string")
    return rows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _packed(positions: list[int]) -> bytes:
    gaps = np.diff(np.array(positions, np.int64), prepend=0)
    return gaps.astype("<u4").tobytes()


def _positions(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4").astype(np.int64))


def build_index(
    docs: DataFrame,
    terms: list[str] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Postings and document rows, by block.

    Posting rows: ``block, term, n, postings``. Document rows have a null ``term``:
    ``block, n`` (words), ``start`` (position of the first word), ``doc_id`` and the row
    key. ``terms``: index only these (the words that any phrase has).
    """
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(frozenset(terms)) if terms is not None else None
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(docs_rows: list[tuple], found: dict[str, list[int]], block: int, id_type: pa.DataType) -> pa.RecordBatch:
        n_docs, names = len(docs_rows), list(found)
        ids, key1, key2, starts, counts = zip(*docs_rows, strict=True)
        none = [None] * len(names)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * (n_docs + len(names)), pa.int64()),
                pa.array([None] * n_docs + names, pa.string()),
                pa.array([*counts, *(len(found[t]) for t in names)], pa.int64()),
                pa.array([None] * n_docs + [_packed(found[t]) for t in names], pa.binary()),
                pa.array([*starts, *none], pa.int64()),
                pa.array([*ids, *none], id_type),
                pa.array([*key1, *none], pa.int64()),
                pa.array([*key2, *none], pa.int32()),
            ],
            names=["block", "term", "n", "postings", "start", "doc_id", "_key1", "_key2"],
        )

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value if wanted else None
        block = (TaskContext.get().partitionId()) << 24
        docs_rows, found, at, id_type = [], {}, 0, None
        for batch in slices(batches, "text"):
            id_type = batch.schema.field("doc_id").type
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "_key1", "_key2", "text"))
            for ident, key1, key2, body in zip(*columns, strict=True):
                w = words(body)
                if docs_rows and at + len(w) > block_words:
                    yield rows(docs_rows, found, block, id_type)
                    block, docs_rows, found, at = block + 1, [], {}, 0
                docs_rows.append((ident, key1, key2, at, len(w)))
                for i, term in enumerate(w, at):
                    if keep is None or term in keep:
                        if term in found:
                            found[term].append(i)
                        else:
                            found[term] = [i]
                at += len(w) + 1
        if docs_rows:
            yield rows(docs_rows, found, block, id_type)

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *row_key(doc_id, text))
    schema = f"block long, term string, n long, postings binary, start long, doc_id {kind}, _key1 long, _key2 int"
    return narrow.mapInArrow(index, schema)


def phrase_starts(lists: list[np.ndarray], order: list[int]) -> np.ndarray:
    """Positions where word k of a phrase stands at start + k, for every k, rarest list first."""
    starts = lists[order[0]] - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        there = lists[k]
        i = np.searchsorted(there, starts + k)
        starts = starts[there[np.minimum(i, len(there) - 1)] == starts + k]
    return starts


def around(at: np.ndarray, there: np.ndarray, span: int) -> np.ndarray:
    """The positions ``at`` with one of ``there`` less than ``span`` away on either side."""
    next_ = there.take(np.searchsorted(there, at - span + 1), mode="clip")
    return at[np.abs(next_ - at) < span]


def near_starts(
    lists: list[np.ndarray], order: list[int], span: int, docs: tuple[np.ndarray, np.ndarray] | None = None, rarest: np.ndarray | None = None
) -> np.ndarray:
    """Starts of all runs of ``span`` positions that hold every word of a phrase, in any order
    and as often as the phrase has it.

    A run starts at most ``span - 1`` before the rarest word. ``docs``: first positions and
    lengths of the documents in order; runs are clipped to the document of the rarest word.
    ``rarest``: the only positions of that word to look around (all by default).
    """
    if rarest is None:
        rarest = lists[order[0]]
    starts = rarest[:, None] - np.arange(span)[None, :]
    if docs is not None:
        first, length = docs
        starts = np.maximum(starts, first[np.searchsorted(first, rarest, "right") - 1][:, None])
    starts = np.unique(starts.ravel())
    ends = starts + span
    if docs is not None:
        row = np.searchsorted(first, starts, "right") - 1
        ends = np.minimum(ends, first[row] + length[row])
    for k in order[1:]:
        if not len(starts):
            break
        there = lists[k]
        i = np.searchsorted(there, starts) + sum(lists[j] is there for j in order) - 1
        held = (i < len(there)) & (there[np.minimum(i, len(there) - 1)] < ends)
        starts, ends = starts[held], ends[held]
    return starts


def search(index: DataFrame, wanted: list[tuple[list[str], list[str]]], slop: int | None = None) -> DataFrame:
    """Per indexed document, where the phrases occur.

    ``index``: from ``build_index``, stored. ``wanted``: (words, items) of at most
    ``PHRASES_AT_ONCE`` phrases, which every executor gets. Without ``slop``, exact phrases;
    with it, also runs of ``len(words) + slop`` words of one document (all of a shorter one) with
    every word in any order. Returns ``doc_id, _key1, _key2, block, start, n_words, spans`` (word numbers, end
    exclusive; neighbours joined) and ``items``; a document without matches has empty arrays.
    With ``slop``, ``exact_spans`` and ``exact_items`` tell the exact phrases among them.
    """
    spark = index.sparkSession
    frequency = {}
    asked = spark.createDataFrame([(t,) for t in {t for p, _ in wanted for t in p}], "term string")
    for r in index.where("term is not null").join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[r["term"]] = r["n"]
    plan: dict[str, list[tuple[list[str], list[str], list[int]]]] = {}
    for phrase, items in wanted:
        if all(t in frequency for t in phrase):
            order = sorted(range(len(phrase)), key=lambda k, p=phrase: (frequency[p[k]], k))
            plan.setdefault(phrase[order[0]], []).append((phrase, items, order))
    sent = spark.sparkContext.broadcast(plan)
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def joined(spans: list[list[tuple[int, int]]]) -> pa.Array:
        merged = []
        for own in spans:
            out: list[list[int]] = []
            for a, b in sorted(set(own)):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b])
            merged.append([{"start": a, "end": b} for a, b in out])
        return pa.array(merged, pair)

    def named(items: list[set[str]]) -> pa.Array:
        return pa.array([sorted(s) for s in items], pa.list_(pa.string()))

    def look(table: pa.Table) -> pa.Table:
        is_doc = np.array(table.column("term").is_null())
        docs = table.filter(pa.array(is_doc)).sort_by("start")
        posts = table.filter(pa.array(~is_doc))
        lists = {t: _positions(p) for t, p in zip(posts.column("term").to_pylist(), posts.column("postings").to_pylist(), strict=True)}
        starts = np.array(docs.column("start"), np.int64)
        lengths = np.array(docs.column("n"), np.int64)
        spans: list[list[tuple[int, int]]] = [[] for _ in starts]
        items: list[set[str]] = [set() for _ in starts]
        near_spans: list[list[tuple[int, int]]] = [[] for _ in starts]
        near_items: list[set[str]] = [set() for _ in starts]

        def note(at: np.ndarray, size: int, names: list[str], spans: list[list[tuple[int, int]]], items: list[set[str]]) -> None:
            rows = np.searchsorted(starts, at, "right") - 1
            for row, a in zip(rows.tolist(), at.tolist(), strict=True):
                a -= int(starts[row]) if row >= 0 else 0
                if row >= 0 and a >= 0:
                    spans[row].append((a, min(a + size, int(lengths[row]))))
                    items[row].update(names)

        plan = sent.value
        for rarest in lists.keys() & plan.keys():
            close: dict[tuple[str, int], np.ndarray] = {}  # windows of an item mostly share their two rarest words
            for phrase, names, order in plan[rarest]:
                if not all(t in lists for t in phrase):
                    continue
                own = [lists[t] for t in phrase]
                if slop is not None:
                    run, at = len(phrase) + slop, lists[rarest]
                    if len(order) > 1:
                        second = (phrase[order[1]], run)
                        if second not in close:
                            close[second] = around(at, own[order[1]], run)
                        at = close[second]
                    for k in order[2:]:
                        if not len(at):
                            break
                        at = around(at, own[k], run)
                    if not len(at):  # then there is no exact phrase either
                        continue
                    note(near_starts(own, order, run, (starts, lengths), at), run, names, near_spans, near_items)
                note(phrase_starts(own, order), len(phrase), names, spans, items)
        found = {"spans": joined(spans), "items": named(items)}
        if slop is not None:
            found = {
                "spans": joined([a + b for a, b in zip(spans, near_spans, strict=True)]),
                "items": named([a | b for a, b in zip(items, near_items, strict=True)]),
                "exact_spans": found["spans"],
                "exact_items": found["items"],
            }
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "_key1": docs.column("_key1"),
                "_key2": docs.column("_key2"),
                "block": docs.column("block"),
                "start": docs.column("start"),
                "n_words": docs.column("n"),
                **found,
            }
        )

    kind = index.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _key1 long, _key2 int, block long, start long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    if slop is not None:
        schema += ", exact_spans array<struct<start: long, end: long>>, exact_items array<string>"
    return index.groupBy("block").applyInArrow(look, schema)


def decontaminate(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    slop: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    at_once: int = PHRASES_AT_ONCE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, _key1, _key2, n_words, spans, n_hit, items``.

    ``spans`` are the hit words, ``n_hit`` their number, ``items`` the ids (as text, sorted)
    of the test items with a phrase there. With ``slop`` these count proximity matches too, and
    ``exact_spans, n_exact, exact_items`` are the same of exact phrases alone. Null and empty texts have no words and no hits;
    repeated rows and repeated ids are judged one by one; an empty test set hits nothing.
    Test sets of any size are searched ``at_once`` phrases at a time over the stored index.
    """
    asked = stored(spark, phrases(items, window, item_id, item_text), "phrases")
    n_phrases = asked.count()
    terms = asked.select(F.explode("words").alias("term")).distinct()
    vocabulary = [r["term"] for r in terms.limit(VOCABULARY + 1).collect()]
    only = vocabulary if len(vocabulary) <= VOCABULARY else None  # more: all words are indexed
    index = stored(spark, build_index(docs, only, doc_id, text, block_words), "postings")
    turns = max(1, -(-n_phrases // at_once))
    found = None
    for turn in range(turns):
        part = asked.where(F.pmod(F.xxhash64("words"), F.lit(turns)) == turn) if turns > 1 else asked
        hits = search(index, [(r["words"], r["items"]) for r in part.collect()], slop)
        found = hits if found is None else found.unionByName(hits)
    pairs = [("spans", "items", "n_hit")] + ([("exact_spans", "exact_items", "n_exact")] if slop is not None else [])
    if turns > 1:
        both = []
        for spans, names, _ in pairs:
            both += [F.flatten(F.collect_list(spans)).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list(names)))).alias(names)]
        found = found.groupBy("block", "start", "doc_id", "_key1", "_key2", "n_words").agg(*both)
    out = [c for spans, names, n in pairs for c in (F.col(spans), _covered(spans).alias(n), F.col(names))]
    return found.select("doc_id", "_key1", "_key2", "n_words", *out)


def _covered(spans: str) -> Column:
    """Words in any of ``spans``, which may overlap."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["to"]))).alias("n"),
            F.greatest(acc["to"], s["end"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )
