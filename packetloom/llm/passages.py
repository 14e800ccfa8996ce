"""Substring dedup: equal lines or paragraphs are kept once in the whole corpus.

Beside it, passages that documents share wherever they begin and end: across lines, inside them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.common import row_key, slices, stored

SEPARATORS = {"line": "\n", "paragraph": "\n\n"}

WORD = re.compile(r"[^\W_]+")
"""Runs of letters and digits, as ``normalised`` leaves them."""

LONG = 1 << 20
"""Characters of a text whose words are not listed all at once."""

AT_ONCE = 1 << 18
"""Windows of a text that are hashed at once."""

KNOWN = 1 << 18
"""Words of at most 64 characters whose hashes a task keeps."""

BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def normalised(unit: Column) -> Column:
    """Lower case, runs of characters other than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "))


def digest(unit: Column) -> list[Column]:
    """128 bits of a normalised unit, as two numbers."""
    md5 = F.md5(unit)
    return [F.conv(F.substring(md5, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"_d{i}") for i in (0, 1)]


def dedup_units(
    spark: SparkSession,
    docs: DataFrame,
    unit: str = "line",
    min_words: int = 1,
    min_chars: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    rank: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_units, n_removed_words, n_repeated_words,
    longest_repeated, removed, kept_text``.

    Units are lines, or paragraphs (cut at two line ends). A unit of at least ``min_words``
    words after normalising takes part, or of at least ``min_chars`` characters if that is
    given (some scripts have no spaces); others always stay. Of equal units the one that
    ranks first stays: by ``rank`` (the document id if none is given; nulls rank last), the
    row key, then the place in the text. ``removed`` has start and end offsets (code points
    of the original text, end exclusive, without the separator) in text order;
    ``kept_text`` is the rest, joined again. ``n_repeated_words`` counts the words in units
    that equal a unit of another document, the kept first one included, and
    ``longest_repeated`` those of the largest: what tells all holders of a passage. Rows that
    agree in id and text are one document and get equal results. Null texts have no units
    and stay null.
    """
    sep = SEPARATORS[unit]
    ranked = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(doc_id) if rank is None else rank).alias("_rank"), *row_key(doc_id, text)
    )
    parts = F.split("text", sep, -1)
    units = ranked.select("_rank", "_key1", "_key2", F.posexplode(parts).alias("unit", "body"))
    units = units.select("_rank", "_key1", "_key2", "unit", normalised(F.col("body")).alias("body"))
    units = units.withColumn("words", F.size(F.filter(F.split("body", " "), lambda w: w != "")))
    taken = (F.col("words") >= min_words) | (F.length("body") >= min_chars if min_chars is not None else F.lit(False))
    units = units.where((F.col("body") != "") & taken).select(*digest(F.col("body")), "_rank", "_key1", "_key2", "unit", "words")
    units = stored(spark, units, "units")

    place = F.struct(F.col("_rank").isNull().alias("none"), "_rank", "_key1", "_key2", "unit")
    document = F.struct("_key1", "_key2")
    several = (F.min(document) != F.max(document)).alias("shared")
    first = units.groupBy("_d0", "_d1").agg(F.min(place).alias("first"), several, F.count("*").alias("n")).where("n > 1").drop("n")
    # Stored, its size is known before the join, and a digest with many units can be split there.
    first = stored(spark, first, "first")
    again = units.join(first, ["_d0", "_d1"]).select("_key1", "_key2", F.struct("unit", "words", "shared", (place != F.col("first")).alias("gone")).alias("u"))
    again = again.groupBy("_key1", "_key2").agg(F.collect_set("u").alias("_again"))
    joined = ranked.join(again, ["_key1", "_key2"], "left").drop("_key1", "_key2", "_rank")
    own = F.coalesce("_again", F.array().cast(again.schema["_again"].dataType))

    def total(which: str) -> Column:
        return F.aggregate(F.filter(own, lambda u: u[which]), F.lit(0).cast("long"), lambda n, u: n + u["words"])

    joined = joined.select(
        "doc_id",
        "text",
        F.transform(F.filter(own, lambda u: u["gone"]), lambda u: u["unit"]).alias("_gone"),
        total("gone").alias("n_removed_words"),
        total("shared").alias("n_repeated_words"),
        F.coalesce(F.array_max(F.transform(F.filter(own, lambda u: u["shared"]), lambda u: u["words"])), F.lit(0)).cast("long").alias("longest_repeated"),
    )

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_units, removed, kept = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist(), strict=True):
                own = text.split(sep) if text is not None else []
                gone = set(gone or ())
                ends = list(accumulate(len(u) + len(sep) for u in own))
                n_units.append(len(own))
                removed.append([{"start": ends[i] - len(sep) - len(own[i]), "end": ends[i] - len(sep)} for i in sorted(gone)])
                kept.append(sep.join(u for i, u in enumerate(own) if i not in gone) if text is not None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_units, pa.int32()), *[batch.column(c) for c in numbers], pa.array(removed, span), pa.array(kept, pa.string())],
                names=["doc_id", "n_units", *numbers, "removed", "kept_text"],
            )

    numbers = ["n_removed_words", "n_repeated_words", "longest_repeated"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_units int, {', '.join(f'{c} long' for c in numbers)}, removed array<struct<start: long, end: long>>, kept_text string"
    return joined.mapInArrow(keep, schema)


class Hashes(dict):
    """XXH64 of words in lower case, most of them remembered."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        found = WORD.findall(text) if len(text) <= LONG else (m[0] for m in WORD.finditer(text))
        return np.frombuffer(array("Q", map(self.__getitem__, found)), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers whose order says nothing of ``x`` (the finisher of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(values: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """A 64-bit number for each ``k`` values in a row (polynomials, put together by doubling)."""
    out, done, part, size = np.zeros(len(values) - k + 1, np.uint64), 0, values, 1
    power = lambda n: np.uint64(pow(int(base), n, 1 << 64))
    while True:
        if k & size:
            out += part[done : done + len(out)] * power(done)
            done += size
        if done == k:
            return mixed(out)
        part = part[:-size] + part[size:] * power(size)
        size *= 2


def anchors(values: np.ndarray, words: int) -> np.ndarray:
    """For each window of ``words`` values the least number of the runs of half of them in it:
    equal windows have equal ones, and neighbours mostly share theirs."""
    k = (words + 1) // 2
    least, size, runs = rolled(values, k, BASES[0]), 1, words - k + 1
    n = len(values) - words + 1
    while 2 * size <= runs:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[:n], least[runs - size : runs - size + n])


def extent(text: str) -> dict[str, int]:
    """From the first word of a text to its last one."""
    last = len(text)
    while not WORD.match(text, last - 1):
        last -= 1
    return {"start": WORD.search(text).start(), "end": last}


def blocks(values: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Place and values of at most ``AT_ONCE`` windows; none for fewer values than a window has."""
    for at in range(0, len(values) - words + 1, AT_ONCE):
        yield at, values[at : at + AT_ONCE + words - 1]


def repeated_passages(spark: SparkSession, docs: DataFrame, words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_passage_words, longest_passage, passages``.

    A passage is a window of ``words`` words in a row (runs of letters and digits, case aside)
    that another document has too, wherever its lines end; windows that overlap or follow each
    other are one. ``passages`` has start and end offsets (code points of the original text, end
    exclusive) in text order, ``n_passage_words`` and ``longest_passage`` count their words. All
    holders are told, the first included. Rows that agree in id and text are one document and
    get equal results. Null texts have no words.

    Texts of the same words are compared once. Of the others, each window is named by the least
    hash among its runs of half a window (winnowing); only windows whose name another text has are
    hashed whole (128 bits) and met with those of all others, so no shared window is lost.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in slices(batches):
            nodes, sizes, ends, names = [], [], [], []
            for body in batch.column("text").to_pylist():
                values = hashes.of(body or "")
                nodes.append(xxhash.xxh3_128_digest(values.tobytes()))
                sizes.append(len(values))
                own = [np.unique(anchors(v, words)) for _, v in blocks(values, words)]
                names.append(np.unique(np.concatenate(own)).view(np.int64) if own else None)
                ends.append(extent(body) if own else None)
            columns = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(ends, span), pa.array(names, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", *key)), *columns], names=["doc_id", *key, "node", "n_words", "extent", "names"])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in slices(batches):
            for i, (body, names) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_names"), strict=True)):
                values, wanted = hashes.of(body), names.values.to_numpy().view(np.uint64)
                first, last = array("q"), array("q")
                for m in WORD.finditer(body):
                    first.append(m.start())
                    last.append(m.end())
                first, last = np.frombuffer(first, np.int64), np.frombuffer(last, np.int64)
                for at, v in blocks(values, words):
                    own = np.flatnonzero(np.isin(anchors(v, words), wanted))
                    place = own + at
                    columns = [rolled(v, words, b)[own].view(np.int64) for b in BASES[1:]]
                    columns += [np.full(len(own), batch.column(c)[i].as_py(), t) for c, t in zip(key, (np.int64, np.int32), strict=True)]
                    columns += [place, first[place], last[place + words - 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_w0", "_w1", *key, "place", "start", "end"])

    key = ["_key1", "_key2"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kind = docs.schema[doc_id].dataType.simpleString()
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *row_key(doc_id, text))
    schema = f"doc_id {kind}, _key1 long, _key2 int, node binary, n_words long, extent struct<start: long, end: long>, names array<long>"
    texts = stored(spark, keyed.mapInArrow(read, schema), "texts")

    # One document stands for all that have its words.
    document = F.struct(*key)
    nodes = texts.where("names is not null").groupBy("node")
    nodes = nodes.agg(F.min(document).alias("first"), (F.min(document) != F.max(document)).alias("copied"), F.any_value("names").alias("names"))
    nodes = stored(spark, nodes, "nodes")

    several = [F.min(c) != F.max(c) for c in key]
    named = nodes.select("first.*", F.explode("names").alias("name"))
    common = stored(spark, named.groupBy("name").agg((several[0] | several[1]).alias("shared")).where("shared").select("name"), "names")
    asked = named.join(common.hint("merge"), "name").groupBy(*key).agg(F.collect_set("name").alias("_names"))
    found = keyed.select("text", *key).join(asked.hint("merge"), key)
    found = stored(spark, found.mapInArrow(hashed, "_w0 long, _w1 long, _key1 long, _key2 int, place long, start long, end long"), "windows")
    common = stored(spark, found.groupBy("_w0", "_w1").agg((several[0] | several[1]).alias("shared")).where("shared").drop("shared"), "common")
    found = found.join(common.hint("merge"), ["_w0", "_w1"]).select(*key, "place", "start", "end")

    # Windows in a row are one passage; a document's windows are sorted, not gathered.
    order = Window.partitionBy(*key).orderBy("place")
    begins = F.coalesce(F.col("place") - F.lag("place").over(order) > words, F.lit(True)).cast("long")
    found = found.withColumn("_begins", begins)
    found = found.withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = [F.min("start").alias("start"), F.max("end").alias("end"), (F.max("place") - F.min("place") + words).alias("size")]
    found = found.groupBy(*key, "_run").agg(*ends).groupBy(*key)
    own = F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_passages")
    found = found.agg(F.sum("size").alias("_count"), F.max("size").alias("_longest"), own)

    copied = nodes.where("copied").select("node", "copied")
    out = texts.drop("names").join(copied.hint("merge"), "node", "left").join(found.hint("merge"), key, "left")
    whole = F.col("copied").isNotNull()
    none = F.array().cast("array<struct<start: long, end: long>>")
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("_count", F.lit(0).cast("long"))).alias("n_passage_words"),
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("_longest", F.lit(0).cast("long"))).alias("longest_passage"),
        F.when(whole, F.array("extent")).otherwise(F.coalesce("_passages", none)).alias("passages"),
    )
