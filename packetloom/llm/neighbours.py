"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is indexed in the leaf it descends to. A
query walks the tree through a priority queue of branches, nearest centroid first, and reads
whole leaves. How many it reads is widened until queries whose true neighbours are known
from a pass over all rows find ``TARGET`` of them.

Equal vectors are one entry of the index with its smallest ids: of k neighbours and the
query itself no more than the first k + 1 copies of a vector can be among the nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from packetloom.llm.common import stored

SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
"""The tree is fitted on about so many vectors, and no more bytes of them."""

BRANCH, LEAF, ROUNDS = 16, 64, 8
"""Children of a node, sample vectors below which a node is a leaf, rounds of k-means."""

CALIBRATION, TARGET, WIDEN = 200, 0.95, 1.1
"""Queries with known neighbours, the recall they have to reach, the step of leaf visits."""

PIECE_ROWS = (2_048, 131_072)
"""Index entries in one task: the lower number, or a 2,048th of all up to the upper."""

QUERY_ROWS = 16_384
"""Queries that a task compares with its entries."""

SEED = 42


class Tree:
    """Nodes with the centroids of their children; leaves are numbered from 0 in tree order."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF):
        rng = np.random.default_rng(SEED)
        self.children: list[tuple[np.ndarray, list[int]] | None] = []
        todo, self.leaf_of = [(sample, -1, 0)], {}
        while todo:
            own, parent, place = todo.pop()
            node = len(self.children)
            if parent >= 0:
                self.children[parent][1][place] = node
            groups = split(own, branch, rng) if len(own) > leaf else []
            if len(groups) < 2:  # few vectors, or all alike
                self.children.append(None)
                self.leaf_of[node] = len(self.leaf_of)
                continue
            self.children.append((np.array([own[g].mean(axis=0) for g in groups]), [0] * len(groups)))
            todo += [(own[g], node, i) for i, g in reversed(list(enumerate(groups)))]

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to."""
        out = np.zeros(len(vectors), np.int32)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None:
                out[rows] = self.leaf_of[node]
                continue
            centroids, below = self.children[node]
            nearest = squares(vectors[rows], centroids).argmin(axis=1)
            todo += [(child, rows[nearest == i]) for i, child in enumerate(below) if (nearest == i).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first: down to the nearest child each time,
        its siblings wait in a queue by the distance of their centroids."""
        waiting, out = [(0.0, 0)], []
        while waiting and len(out) < most:
            node = heapq.heappop(waiting)[1]
            while self.children[node] is not None:
                centroids, below = self.children[node]
                far = squares(query[None], centroids)[0]
                best = int(far.argmin())
                for i, child in enumerate(below):
                    if i != best:
                        heapq.heappush(waiting, (float(far[i]), child))
                node = below[best]
            out.append(self.leaf_of[node])
        return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, up to rounding."""
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T, 0)


def split(vectors: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Row numbers of at most ``k`` groups by Lloyd's k-means."""
    centroids = vectors[rng.permutation(len(vectors))[: min(k, len(vectors) // 2)]]
    for _ in range(ROUNDS):
        own = squares(vectors, centroids).argmin(axis=1)
        centroids = np.array([vectors[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centroids)])
    own = squares(vectors, centroids).argmin(axis=1)
    return [g for i in range(len(centroids)) if len(g := np.flatnonzero(own == i))]


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of ``vectors`` that can be among its ``k`` nearest, with exact
    distances. Rows at the k-th distance are all there."""
    out, room = [], 1e-9 * (1 + np.einsum("ij,ij->i", vectors, vectors).max(initial=0))
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        rough = squares(block, vectors)
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(vectors) > k else np.full(len(block), np.inf)
        for q, row, most in zip(block, rough, limit, strict=True):
            near = np.flatnonzero(row <= most + room * (1 + q @ q))
            out.append((near, np.sqrt(((vectors[near] - q) ** 2).sum(axis=1))))
    return out


def best(rows: np.ndarray, far: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int, int]]:
    """(distance, id, row) of the ``k`` nearest ids, ties to the smaller id."""
    return heapq.nsmallest(k, ((d, i, r) for r, d in zip(rows.tolist(), far.tolist(), strict=True) for i in ids[r]))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def vectors_of(table: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """``_k1, _k2, id, vec`` of the rows that take part, and their dimension.

    Left out: null ids, null or zero vectors, null or non-finite components, and vectors of
    another length than most (a tie goes to the shorter), as they have no distance to these.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~odd & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes else 0
    plain = F.transform("vec", lambda x: F.when(x == 0, 0.0).otherwise(x))  # one zero
    rows = rows.where(F.size("vec") == dim).select("id", plain.alias("vec"))
    return rows.select(F.xxhash64("vec").alias("_k1"), F.hash("vec").alias("_k2"), "id", "vec"), dim


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """``_k1, _k2, vec, ids``: each vector once, with the smallest ``k`` ids of its copies."""
    copies = rows.select("_k1", "_k2", "id").distinct()
    order = Window.partitionBy("_k1", "_k2").orderBy("id")
    first = copies.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)  # limited before the shuffle too
    groups = first.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0])
    return rows.join(groups, ["_k1", "_k2", "id"]).groupBy("_k1", "_k2").agg(F.first("vec").alias("vec"), F.first("ids").alias("ids"))


def some(df: DataFrame, n: int, want: int) -> pa.Table:
    """About ``want`` of ``n`` rows, chosen by hash, in a fixed order."""
    share = F.pmod(F.xxhash64("_k1", "_k2", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, want / max(n, 1)) + 1)
    return df.where(share).toArrow().sort_by([("_k1", "ascending"), ("_k2", "ascending")])


def build(spark: SparkSession, entries: DataFrame, dim: int, sample: int = SAMPLE, branch: int = BRANCH, leaf: int = LEAF) -> tuple[Tree, DataFrame]:
    """A tree fitted on a sample, and all entries with their ``leaf``, stored."""
    entries = stored(spark, entries, "entries")
    fit_on = some(entries.select("_k1", "_k2", "vec"), entries.count(), min(sample, SAMPLE_BYTES // (8 * dim)))
    tree = Tree(matrix(fit_on["vec"], dim), branch, leaf)
    model = spark.sparkContext.broadcast(tree)  # a few thousand centroids, whatever the table

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value.assign(matrix(b.column("vec"), dim)))], names=[*b.schema.names, "leaf"])

    return tree, stored(spark, entries.mapInArrow(assign, "_k1 long, _k2 int, vec array<double>, ids array<long>, leaf int"), "index")


def calibrate(index: DataFrame, tree: Tree, queries: pa.Table, dim: int, k: int, target: float = TARGET) -> int:
    """Leaf visits with which ``queries`` find ``target`` of their true ``k`` neighbours,
    which a pass over the whole index gives."""
    asked = matrix(queries["vec"], dim)
    own = [ids[0] for ids in queries["ids"].to_pylist()]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple[float, int, int]]] = [[] for _ in own]
        for b in batches:
            ids, leaf = b.column("ids").to_pylist(), b.column("leaf").to_pylist()
            for q, (rows, far) in enumerate(nearest(asked, matrix(b.column("vec"), dim), k + 1)):
                found[q] = heapq.nsmallest(k + 1, found[q] + [(d, i, leaf[r]) for d, i, r in best(rows, far, ids, k + 1)])
        flat = [(q, *x) for q, each in enumerate(found) for x in each]
        yield pa.RecordBatch.from_pylist([dict(zip(("q", "d", "id", "leaf"), x, strict=True)) for x in flat], schema=shape)

    shape = pa.schema([("q", pa.int32()), ("d", pa.float64()), ("id", pa.int64()), ("leaf", pa.int32())])
    truth = index.select("vec", "ids", "leaf").mapInArrow(scan, "q int, d double, id long, leaf int")
    truth = truth.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id", "leaf"))), 1, k + 1).alias("near"))
    n_leaves = len(tree.leaf_of)
    ranks = []
    for r in truth.collect():  # one row per calibration query
        place = {leaf: i for i, leaf in enumerate(tree.visits(asked[r["q"]], n_leaves))}
        ranks += [place[x["leaf"]] for x in r["near"] if x["id"] != own[r["q"]]][:k]
    visits = 1.0
    while ranks and int(visits) < n_leaves and np.mean(np.array(ranks) < int(visits)) < target:
        visits = max(visits * WIDEN, visits + 1)
    return min(int(visits), n_leaves)


def shards(index: DataFrame, n_leaves: int, piece_rows: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(leaf, shard, pieces): neighbouring leaves share a shard of bounded rows, a larger
    leaf is dealt into pieces of its own shard."""
    counts = dict.fromkeys(range(n_leaves), 0) | {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    size = min(max(piece_rows[0], sum(counts.values()) // 2048), piece_rows[1])
    out, shard, held = [], 0, 0
    for leaf, n in sorted(counts.items()):
        if held and held + n > size:
            shard, held = shard + 1, 0
        out.append((leaf, shard, -(-max(n, 1) // size)))
        held += n
    return out


def search(
    spark: SparkSession,
    table: DataFrame,
    wanted: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    sample: int = SAMPLE,
    branch: int = BRANCH,
    leaf: int = LEAF,
    target: float = TARGET,
    piece_rows: tuple[int, int] = PIECE_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row that meets
    ``wanted`` (over ``id``), by Euclidean distance in double precision, ties to the smaller id.

    A row is no candidate for its own id. Equal rows are one; rows that share an id but not
    the vector are all candidates, and as queries each of them is answered. Without
    candidates (or in an empty table) there are no rows. See ``vectors_of`` for rows that
    take no part. Groups of index entries and queries that meet in a task are bounded by
    ``piece_rows`` and ``query_rows``.
    """
    rows, dim = vectors_of(table, vec_id, embedding)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asking = stored(spark, rows.where(wanted).select("_k1", "_k2", F.col("id").alias("query_id")).distinct(), "asking")
    tree, index = build(spark, entries_of(rows, k + 1), dim, sample, branch, leaf)
    queries = stored(spark, index.join(asking.select("_k1", "_k2").distinct(), ["_k1", "_k2"], "left_semi").drop("leaf"), "queries")
    visits = calibrate(index, tree, some(queries, queries.count(), CALIBRATION), dim, k, target)

    model = spark.sparkContext.broadcast(tree)
    dealt = shards(index, len(tree.leaf_of), piece_rows)
    shard_of = np.array([s for _, s, _ in dealt])
    pieces = {s: n for _, s, n in dealt}

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query, shard and piece that holds visited leaves."""
        for b in batches:
            out = []
            vectors = matrix(b.column("vec"), dim)
            for row, vec in enumerate(vectors):
                own = np.sort(np.array(model.value.visits(vec, visits), np.int32))
                for part in np.split(own, np.flatnonzero(np.diff(shard_of[own])) + 1):
                    shard = int(shard_of[part[0]])
                    out += [(row, shard, p, part) for p in range(pieces[shard])]
            at = pa.array([x[0] for x in out], pa.int64())
            columns = [b.column(c).take(at) for c in ("_k1", "_k2", "vec")]
            columns += [pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_k1", "_k2", "vec", "shard", "piece", "leaves"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """The nearest entries of one piece for the queries sent there."""
        out: list[tuple[int, float, int]] = []
        if left.num_rows and right.num_rows:
            vectors, asked = matrix(left["vec"], dim), matrix(right["vec"], dim)
            ids, of, visited = left["ids"].to_pylist(), left["leaf"].to_numpy(), right["leaves"].to_pylist()
            askers: dict[int, list[int]] = {}
            for q, leaves in enumerate(visited):
                for x in leaves:
                    askers.setdefault(x, []).append(q)
            found: list[list[tuple[float, int]]] = [[] for _ in visited]
            for x, own in askers.items():
                here = np.flatnonzero(of == x)
                if len(here):
                    for q, (near, far) in zip(own, nearest(asked[own], vectors[here], k + 1), strict=True):
                        found[q] = heapq.nsmallest(k + 1, found[q] + [y[:2] for y in best(here[near], far, ids, k + 1)])
            out = [(q, *x) for q, each in enumerate(found) for x in each]
        at = pa.array([x[0] for x in out], pa.int64())
        return pa.table(
            {"_k1": right["_k1"].take(at), "_k2": right["_k2"].take(at), "d": pa.array([x[1] for x in out], pa.float64()), "id": pa.array([x[2] for x in out], pa.int64())}
        )

    sent = stored(spark, queries.mapInArrow(walk, "_k1 long, _k2 int, vec array<double>, shard int, piece int, leaves array<int>"), "visits")
    blocks = {r["shard"]: -(-r["n"] // query_rows) for r in sent.where("piece = 0").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame([(x, s, n, blocks.get(s, 0)) for x, s, n in dealt], "leaf int, shard int, _pieces int, _blocks int")
    spread = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block")
    entries = index.join(F.broadcast(places.where("_blocks > 0")), "leaf").withColumn("piece", F.pmod("_k1", "_pieces").cast("int"))  # a row per leaf
    entries = entries.select("shard", "piece", spread, "leaf", "vec", "ids")
    sent = sent.join(F.broadcast(places.groupBy("shard").agg(F.max("_blocks").alias("_blocks"))), "shard")
    sent = sent.withColumn("block", F.pmod(F.xxhash64("_k1"), F.col("_blocks")).cast("int")).drop("_blocks")
    key = ["shard", "piece", "block"]
    near = entries.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(compare, "_k1 long, _k2 int, d double, id long")
    near = near.groupBy("_k1", "_k2").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id"))), 1, k + 1).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    answers = asking.join(near, ["_k1", "_k2"]).select("query_id", F.posexplode(others).alias("rank", "x"))
    return answers.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
