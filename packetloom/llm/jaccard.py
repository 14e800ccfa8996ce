"""Near-duplicates by exact Jaccard similarity of word shingles.

The sets' SimHash fingerprints are searched in BK-trees (``simhash.links``) for those within
``RADIUS`` bits. Sets near the threshold differ in some 10 bits of 64, up to 20, where no tree
leaves anything out, so bands of min-hashes propose beside the trees: ``BANDS`` bands of
``ROWS`` values each, so a pair of similarity 0.8 meets in none with a probability of 7e-6, a
pair of more with less. Both only propose: what they join is a group, and within a group pairs
are confirmed on the shingles themselves, so no pair below the threshold is ever linked.
Equal sets are collapsed before, in the map tasks first. A group beyond ``TILE_ROWS`` sets
or ``TILE_SHINGLES`` shingles is dealt into tiles, and its sets are sent to each of them.
Tiles report spanning links only, and components come from the links as for fingerprints.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import simhash
from packetloom.llm.common import row_key, slices, stored
from packetloom.llm.simhash import SEED, components

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 7
"""Bits in which fingerprints differ that the trees propose: the most that they take."""

BANDS, ROWS = 30, 5
TILE_ROWS = 20_000
TILE_SHINGLES = 1 << 22

AT_ONCE = 1 << 12
"""Shingles of a document that are permuted at once."""

FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Different XXH64 values of the word shingles, in order; none for a text without words.

    Words are those of ``simhash.fingerprint``. Fewer words than ``shingle`` are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    body = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(body)]
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(body[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)], np.uint64))


def bands(values: np.ndarray) -> np.ndarray:
    """One number for each band of min-hashes; none for an empty set."""
    if not len(values):
        return np.zeros(0, np.int64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), AT_ONCE):
        least = np.minimum(least, np.multiply.outer(FACTORS, values[i : i + AT_ONCE]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def signatures(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, _key1, _key2, node, n, bands, fp`` for each row; ``node`` is 128 bits of the set, ``n``
    its size, ``fp`` its SimHash fingerprint as a signed number."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingles(t, shingle) for t in b.column("text").to_pylist()]
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            columns = [pa.array(nodes, pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            columns.append(pa.array(np.array([simhash.of_hashes(s) for s in sets], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_key1"), b.column("_key2"), *columns], names=["doc_id", "_key1", "_key2", "node", "n", "bands", "fp"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *row_key(doc_id, text))
    return narrow.mapInArrow(read, f"doc_id {kind}, _key1 long, _key2 int, node binary, n long, bands array<long>, fp long")


def set_links(sets: list[np.ndarray], members: int, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Spanning links (pairs of numbers): every set is joined to all that the first ``members``
    sets join and that it is alike.

    Alike sets share one of each other's rarest values, of which there are few. Those are kept
    by component, so that a set looks at none that it is already joined to.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))  # rare ones first
    terms = [np.sort(x) for x in np.split(rank[flat], np.cumsum(sizes)[:-1])]
    own = [t[: len(t) - int(np.ceil(threshold * len(t) - 1e-9)) + 1].tolist() if len(t) else [] for t in terms]
    mark = np.zeros(len(times), np.int64)
    where: dict[int, dict[int, list[int]]] = defaultdict(dict)
    root, parts, out = list(range(len(sets))), [[i] for i in range(len(sets))], []

    def alike(i: int, others: list[int]) -> np.ndarray:
        """Which of ``others`` (not empty) are alike ``i``, whose terms are marked."""
        starts = np.concatenate(([0], np.cumsum(sizes[others])[:-1]))
        both = np.add.reduceat(mark[np.concatenate([terms[j] for j in others])], starts)
        return both >= threshold * (sizes[i] + sizes[others] - both) - 1e-9

    def join(a: int, b: int) -> None:
        """Components ``a`` and ``b`` become one; the smaller one moves."""
        if len(parts[a]) < len(parts[b]):
            a, b = b, a
        for j in parts[b]:
            root[j] = a
            for t in own[j]:
                if moved := where[t].pop(b, None):
                    where[t].setdefault(a, []).extend(moved)
        parts[a] += parts[b]
        parts[b] = []

    for i in range(len(sets)):
        mark[terms[i]] = 1
        seen: set[int] = set()
        for t in own[i]:
            for r in list(where[t]):
                if root[r] == root[i]:
                    continue
                todo = [j for j in where[t].get(r, ()) if j not in seen and threshold * max(sizes[i], sizes[j]) <= min(sizes[i], sizes[j]) + 1e-9]
                at, step = 0, 1
                while at < len(todo):
                    part = todo[at : at + step]
                    seen.update(part)
                    if len(found := np.flatnonzero(alike(i, part))):
                        out.append((part[found[0]], i))
                        join(root[i], root[r])
                        break
                    at, step = at + step, min(4 * step, 1024)
        mark[terms[i]] = 0
        if i < members:
            for t in own[i]:
                where[t].setdefault(root[i], []).append(i)
    return out


def links(spark: SparkSession, docs: DataFrame, members: DataFrame, shingle: int, threshold: float, doc_id: str, text: str) -> DataFrame:
    """Spanning links ``a, b`` (two nodes) among ``members``: ``node, at`` (a row's key)``, grp, own, trees``."""
    kept = members.select("node", "grp", "own", "trees", F.col("at._key1").alias("_key1"), F.col("at._key2").alias("_key2"))
    # The members grow with the documents: they are never sent to all tasks, however few they are here.
    rows = docs.select(F.col(text).alias("text"), *row_key(doc_id, text)).join(kept.hint("merge"), ["_key1", "_key2"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingles(t, shingle).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "grp", "own")), pa.array(sets, pa.binary())], names=["node", "grp", "own", "body"])

    sets = rows.select("text", "node", "grp", "own").mapInArrow(cut, "node binary, grp long, own int, body binary")
    # In its own tile a set is a member; to the tiles before, it is a query.
    dealt = sets.select("grp", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("tile"), "own", "node", "body")
    dealt = dealt.select("grp", "tile", (F.col("own") > F.col("tile")).alias("query"), "node", "body")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile, members first; a tile is solved when the next one begins."""
        now, n = None, 0
        nodes: list[bytes] = []
        bodies: list[bytes] = []
        for b in chain(batches, [None]):
            pairs = []
            columns = [b.column(c).to_pylist() for c in ("grp", "tile", "query", "node", "body")] if b is not None else [[None], [None], [None], [None], [None]]
            for grp, tile, query, node, body in zip(*columns, strict=True):
                if (grp, tile) != now:
                    if nodes:
                        pairs += [(nodes[i], nodes[j]) for i, j in set_links([np.frombuffer(x, np.uint64) for x in bodies], n, threshold)]
                    now, n, nodes, bodies = (grp, tile), 0, [], []
                nodes.append(node)
                bodies.append(body or b"")
                n += not query
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    placed = dealt.repartition("grp", "tile").sortWithinPartitions("grp", "tile", "query")
    return placed.mapInArrow(work, "a binary, b binary").where("a != b").distinct()


def tree_links(spark: SparkSession, values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links ``a, b`` among ``values.v``: sets whose fingerprints ``fp`` BK-trees join.

    One set stands for all of its fingerprint; the others are linked to it.
    """
    prints = stored(spark, values.groupBy("fp").agg(F.min("v").alias("v")), "fingerprints")
    found = stored(spark, simhash.links(spark, prints.select("fp"), prints.count(), radius), "trees")
    ends = [prints.select(F.col("fp").alias(end), F.col("v").alias(f"v_{end}")).hint("merge") for end in ("a", "b")]
    across = found.join(ends[0], "a").join(ends[1], "b").select(F.col("v_a").alias("a"), F.col("v_b").alias("b"))
    same = values.select("fp", F.col("v").alias("a")).join(prints.select("fp", F.col("v").alias("b")).hint("merge"), "fp").where("a != b")
    return across.unionByName(same.select("a", "b"))


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    doc_id: str = "doc_id",
    text: str = "text",
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, _key1, _key2, root``.

    Rows whose sets of ``shingle`` words have a Jaccard similarity of at least ``threshold``
    (0.8 or more, which trees and bands are made for) are linked; ``root`` names the component.
    Texts without words are copies of each other.
    """
    if not 0.8 <= threshold <= 1:
        raise ValueError("threshold must be between 0.8 and 1")
    prints = stored(spark, signatures(docs, shingle, doc_id, text), "signatures")
    values = prints.groupBy("node").agg(F.min(F.struct("_key1", "_key2")).alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    values = stored(spark, values.withColumn("v", F.xxhash64("node")), "values")

    rows = values.select("v", F.explode("bands").alias("band"))
    ends = rows.groupBy("band").agg(F.min("v").alias("b"), F.max("v").alias("last")).where("b < last").select("band", "b")
    ends = stored(spark, ends, "bands")
    banded = rows.join(ends, "band").where("v != b").select(F.col("v").alias("a"), "b")
    near = components(spark, tree_links(spark, values).unionByName(banded))
    groups = near.select(F.col("node").alias("v"), F.col("root").alias("grp")).unionByName(near.select(F.col("root").alias("v"), F.col("root").alias("grp")).distinct())
    found = stored(spark, values.select("v", "node", "at", "n").join(groups, "v"), "groups")
    trees = F.greatest(F.ceil(F.count("*") / tile_rows), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    sizes = stored(spark, found.groupBy("grp").agg(trees.alias("trees")), "sizes")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("trees").cast("long")).cast("int")
    members = stored(spark, found.join(sizes, "grp").withColumn("own", own), "members")

    roots = components(spark, links(spark, docs, members, shingle, threshold, doc_id, text))
    labels = stored(spark, roots.select("node", "root"), "labels")
    return prints.join(labels, "node", "left").select("doc_id", "_key1", "_key2", F.coalesce("root", "node").alias("root"))
