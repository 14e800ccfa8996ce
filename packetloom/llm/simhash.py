"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Two fingerprints within ``RADIUS`` bits agree in whole blocks of bits when the 64 bits are
cut into more than ``RADIUS`` blocks. A few bits of each choice of such blocks are a shard
key, just enough for about ``TREE_ROWS`` fingerprints a shard, so linked fingerprints meet in
at least one shard and a corpus of any size has shards of one size. A shard is a BK-tree
whose children are keyed by their integer distance to the parent; a query follows only edges
that the radius allows. The fingerprints of shards beyond ``SHARD_ROWS`` are sharded again
by whole blocks, then by more and smaller ones; only what agrees in half of its bits and is
still too many is dealt into trees of that size, with queries sent to each of them.
Shards report spanning links only, and components come from the links by repeated
large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import row_key, slices, stored

RADIUS = 3
SEED = 42
SHARD_ROWS = 20_000
"""A shard of more fingerprints is cut further."""

TREE_ROWS = 4_096
"""Fingerprints in a shard's tree, about."""

TASKS = 20_000
"""Tasks of a search at most."""

LEAF = 8
"""Subtrees up to this size are compared directly."""

AT_ONCE = 1 << 16
"""Shingles of a document whose bits are counted at once."""


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of word shingles, repeats included; 0 for a text without words.

    Words end at ASCII white space, A-Z in lower case. A bit is set if it is set in over
    half of the shingles' XXH64 values. Fewer words than ``shingle`` are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(body)]
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    return of_hashes(np.array([h(body[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)], np.uint64))


def of_hashes(values: np.ndarray) -> int:
    """The bits that are set in over half of the values; 0 for none."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(values), AT_ONCE):
        part = values[i : i + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, _key1, _key2, fp`` for each row; ``fp`` is the fingerprint as a signed number."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_key1"), b.column("_key2"), pa.array(fps)], names=["doc_id", "_key1", "_key2", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *row_key(doc_id, text))
    return narrow.mapInArrow(read, f"doc_id {kind}, _key1 long, _key2 int, fp long")


def key_levels(n: int, radius: int = RADIUS, rows: int = TREE_ROWS) -> list[list[list[tuple[int, int]]]]:
    """Bit ranges of each shard key, level by level, coarse ones first.

    The keys of every level cover all links: ``blocks`` cuts, of which a link leaves all but
    ``radius`` untouched. The first level takes only so many bits of each key that ``n``
    random fingerprints come to about ``rows`` a place, the next ones whole blocks.
    """
    wanted = max(0, (max(n, 1) - 1) // rows).bit_length()
    levels: list[list[list[tuple[int, int]]]] = []
    most = max(2 * radius, radius + 1)
    for blocks in range(radius + 1, most + 1):
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        keys = [[(cuts[i], cuts[i + 1]) for i in chosen] for chosen in combinations(range(blocks), blocks - radius)]
        held = min(sum(b - a for a, b in key) for key in keys)
        if not levels and held < wanted and blocks < most:
            continue
        if not levels and wanted < held:
            levels.append([_first_bits(key, wanted) for key in keys] if wanted else [[]])
        levels.append(keys)
    return levels


def _first_bits(key: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The ranges of ``key``, cut off after ``n`` bits."""
    out = []
    for a, b in key:
        if n > 0:
            out.append((a, min(b, a + n)))
            n -= b - a
    return out


def shard_keys(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Bit ranges of the shard keys that ``n`` fingerprints are searched by first."""
    return key_levels(n, radius)[0]


def _bits(fp: Column, ranges: list[tuple[int, int]]) -> Column:
    """The bits of ``ranges``, next to each other."""
    out = F.lit(0).cast("long")
    for a, b in ranges:
        part = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))
        out = F.shiftleft(out, b - a).bitwiseOR(part)
    return out


def merge(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find in bulk: ``up`` holds each number's root (the smallest of its set), before and after."""
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return up
        np.minimum.at(up, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while not np.array_equal(up, further := up[up]):
            up = further


class BKTree:
    """Fingerprints in a tree whose children are keyed by their Hamming distance to the parent."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.nodes: list[tuple[int, dict[int, int], np.ndarray | None]] = []
        self.top = self._grow(np.arange(len(values))) if len(values) else -1

    def _grow(self, members: np.ndarray) -> int:
        """Adds a subtree, parents before children, without recursion."""
        first = len(self.nodes)
        todo = [(members, -1, -1)]
        while todo:
            own, parent, edge = todo.pop()
            node = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][1][edge] = node
            if len(own) <= LEAF:
                self.nodes.append((-1, {}, own))
                continue
            self.nodes.append((int(own[0]), {}, None))
            rest = own[1:]
            far = np.bitwise_count(self.values[rest] ^ self.values[own[0]])
            for d in np.unique(far).tolist():
                todo.append((rest[far == d], node, d))
        return first

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, member numbers) within ``radius``, in pieces, all queries going down together."""
        todo = [(self.top, np.arange(len(queries)))] if self.top >= 0 else []
        while todo:
            node, asked = todo.pop()
            pivot, children, leaf = self.nodes[node]
            if leaf is not None:
                for i in range(0, len(asked), 1 << 14):
                    part = asked[i : i + (1 << 14)]
                    q, m = np.nonzero(np.bitwise_count(queries[part][:, None] ^ self.values[leaf][None, :]) <= radius)
                    yield part[q], leaf[m]
                continue
            far = np.bitwise_count(queries[asked] ^ self.values[pivot]).astype(np.int64)
            near = asked[far <= radius]
            yield near, np.full(len(near), pivot)
            for edge, child in children.items():
                sent = asked[np.abs(far - edge) <= radius]
                if len(sent):
                    todo.append((child, sent))


def shard_links(members: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Links (pairs) that join what the tree of ``members`` joins, queries included.

    Every query is linked to each local component it touches, every member to its
    component's root: as many links as values, not as pairs.
    """
    values = np.unique(members)
    tree = BKTree(values)
    up = np.arange(len(values))
    for q, m in tree.search(values, radius):
        up = merge(up, q, m)
    found = [np.stack([values, values[up]], axis=1)]
    for q, m in tree.search(queries, radius):
        found.append(np.unique(np.stack([queries[q], values[up[m]]], axis=1), axis=0))
    pairs = np.concatenate(found)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def leaf_links(shard: np.ndarray, fp: np.ndarray, radius: int, longest: int) -> np.ndarray:
    """Spanning links within many shards of one leaf each, told apart by ``shard`` numbers in order."""
    up = np.arange(len(fp))
    for step in range(1, longest):
        i = np.flatnonzero((shard[step:] == shard[:-step]) & (np.bitwise_count(fp[step:] ^ fp[:-step]) <= radius))
        up = merge(up, i, i + step)
    moved = np.flatnonzero(up != np.arange(len(fp)))
    return np.stack([fp[moved], fp[up[moved]]], axis=1)


def links(spark: SparkSession, values: DataFrame, n: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links ``a, b`` (two fingerprints) among the ``n`` different ``values.fp``.

    Two linked fingerprints share a shard of every level. Those that meet in too large
    shards only are both among the rows of the next level, so none is lost on the way.
    """
    levels = key_levels(n, radius, min(TREE_ROWS, shard_rows))
    rows, found = values.select("fp"), None
    for keys in levels:
        cuts = [F.struct(F.lit(i).alias("cut"), _bits(F.col("fp"), r).alias("bits")) for i, r in enumerate(keys)]
        placed = rows.select("fp", F.explode(F.array(*cuts)).alias("k")).select("k.cut", "k.bits", "fp")
        sizes = stored(spark, placed.groupBy("cut", "bits").agg(F.count("*").alias("n")).where("n > 1"), "shards")
        hot = sizes.where(F.col("n") > shard_rows)
        ends = keys is levels[-1] or hot.isEmpty()
        inside = sizes if ends else sizes.where(F.col("n") <= shard_rows)
        tasks = min(TASKS, 1 + n * len(keys) // (8 * TREE_ROWS))
        part = tree_links(placed, inside, radius, shard_rows, tasks)
        found = part if found is None else found.unionByName(part)
        if ends:
            break
        rows = stored(spark, placed.join(hot, ["cut", "bits"], "left_semi").select("fp").distinct(), "hot")
        n = rows.count()
    return found.distinct()


def tree_links(placed: DataFrame, sizes: DataFrame, radius: int, shard_rows: int, tasks: int) -> DataFrame:
    """Spanning links ``a, b`` within the shards (``cut, bits``) of ``placed.fp`` that ``sizes`` lists with their ``n``."""
    trees = F.ceil(F.col("n") / shard_rows)
    own = F.pmod(F.xxhash64("fp"), trees.cast("long")).cast("int")
    dealt = placed.join(sizes, ["cut", "bits"]).withColumn("own", own)
    # In its own tree a value is a member; to the trees before, it is a query.
    dealt = dealt.select("cut", "bits", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("tree"))
    dealt = dealt.select("cut", "bits", "tree", (F.col("own") == F.col("tree")).alias("member"), "fp")

    def solve(cut: np.ndarray, bits: np.ndarray, tree: np.ndarray, member: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
        """Links of whole shards."""
        new = (np.diff(cut) != 0) | (np.diff(bits) != 0) | (np.diff(tree) != 0)
        shard = np.concatenate(([0], np.cumsum(new)))
        sizes = np.bincount(shard)
        small = (sizes <= LEAF)[shard] & (np.bincount(shard, ~member) == 0)[shard]
        out = [leaf_links(shard[small], fp[small], radius, int(sizes[shard[small]].max(initial=0)))]
        ends = np.cumsum(sizes)
        for s in np.unique(shard[~small]).tolist():
            own = slice(int(ends[s] - sizes[s]), int(ends[s]))
            out.append(shard_links(fp[own][member[own]], fp[own][~member[own]], radius))
        return out

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; the last shard of a batch waits for the next one. A tree has
        about ``shard_rows`` members at most; a query is 8 bytes."""
        held: list[np.ndarray] | None = None
        for b in chain(batches, [None]):
            if b is not None:
                columns = [np.asarray(b.column(c)) for c in ("cut", "bits", "tree", "member", "fp")]
                columns[3] = columns[3].astype(bool)
                columns[4] = columns[4].view(np.uint64)
                held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if held is None or not len(held[0]):
                continue
            n = len(held[0])
            if b is not None:
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
                n = int(last[-1]) + 1 if len(last) else 0
            if n:
                pairs = np.concatenate(solve(*(x[:n] for x in held))).astype(np.uint64).view(np.int64)
                held = [x[n:] for x in held]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    at = ["cut", "bits", "tree"]
    return dealt.repartition(tasks, *at).sortWithinPartitions(*at).mapInArrow(work, "a long, b long")


def components(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; the root is the smallest node reachable.

    Each step links nodes to the smallest neighbour of theirs (large star: the larger
    neighbours; small star: the others), which at least halves the length of chains in
    two steps. Minima are combined in the map tasks, so hubs are no hot groups. Every
    step is written to the shared folder, so none is ever done twice.
    """
    edges = stored(spark, pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        edges = stored(spark, small.where("a != b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    radius: int = RADIUS,
    shingle: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, _key1, _key2, fp, root, component_id``.

    Fingerprints at ``radius`` or fewer differing bits are linked; ``component_id`` is the
    smallest document id that links reach, the row itself included (null if all are null);
    ``root`` is one fingerprint of the component.
    Null and empty texts have fingerprint 0 and are linked like any other. Copies share a
    fingerprint and are collapsed, in the map tasks first, before any search.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be between 0 and 7 bits")
    prints = stored(spark, fingerprints(docs, shingle, doc_id, text), "fingerprints")
    values = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    values = stored(spark, values, "values")
    roots = components(spark, links(spark, values.select("fp"), values.count(), radius, shard_rows))
    rooted = values.join(roots, values["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(spark, rooted.join(smallest, "root").select("fp", "root", "component_id"), "labels")
    return prints.join(labels, "fp").select("doc_id", "_key1", "_key2", "fp", "root", "component_id")
