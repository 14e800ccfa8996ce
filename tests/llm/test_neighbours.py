"""The k-means tree against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import neighbours

COLUMNS = "vec_id long, embedding array<float>, label int, id string, vec string, leaf string, ids int"


@pytest.fixture(scope="module")
def rows():
    """Clusters, a vector with a third of all rows, repeated rows, ties, and rows that take no part."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    out = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    out += [(400 + i, out[7][1]) for i in range(200)]
    out += [out[0], out[0], out[410], (3, out[9][1])]  # equal rows; one id with two vectors
    out += [(600, None), (700, [0.0] * 8), (800, [float("nan")] * 8), (900, [1.0, None] + [1.0] * 6), (1000, [math.inf] * 8), (1100, [1.0] * 5), (None, out[5][1])]
    out += [(1200, [-0.0] + [1.0] * 7), (1201, [0.0] + [1.0] * 7), (1300, [])]
    return out


def brute(rows, k, every):
    """{query: its k nearest (distance, id)} over different rows that take part."""
    ok = {(i, tuple(x + 0.0 for x in v)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids, x = [i for i, _ in ok], np.array([v for _, v in ok])
    out = []
    for q, v in ok:
        if q % every == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1)).tolist()
            out.append((q, sorted((a, i) for a, i in zip(d, ids, strict=True) if i != q)[:k]))
    return dict(out)


def asked(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "a", "b", "c", 2) for r in rows], COLUMNS).repartition(3)
    found = neighbours.search(spark, table, F.col("id") % 10 == 0, sample=200, leaf=16, branch=4, **options).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


@pytest.mark.parametrize("pieces", [(8192, 131072), (20, 20)])
def test_all_leaves_are_brute_force(spark, rows, pieces):
    found = asked(spark, rows, target=2.0, piece_rows=pieces, query_rows=7)
    want = brute(rows, 10, 10)
    assert set(found) == set(want)
    for q, near in want.items():
        assert [i for _, i in found[q]] == [i for _, i in near]
        assert np.allclose([d for d, _ in found[q]], [d for d, _ in near], rtol=1e-13)


def test_recall_is_as_calibrated(spark, rows):
    found, want = asked(spark, rows), brute(rows, 10, 10)
    hits = [len({i for _, i in found[q]} & {i for _, i in near}) / len(near) for q, near in want.items()]
    assert np.mean(hits) >= 0.9


def test_few_candidates_and_empty_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert neighbours.search(spark, none, F.col("id") % 10 == 0).collect() == []
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found = neighbours.search(spark, table, F.col("id") == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 2, math.sqrt(2)), (0, 2, 1, math.sqrt(5))]
    assert neighbours.search(spark, table, F.col("id") == 9).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert neighbours.search(spark, alone, F.col("id") == 0).collect() == []


def test_best_bin_first_reads_every_leaf_once():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    tree = neighbours.Tree(x, branch=5, leaf=20)
    own = tree.assign(x)
    for q in range(20):
        order = tree.visits(x[q], 10**6)
        assert sorted(order) == list(range(len(tree.leaf_of)))
        assert order[0] == own[q] and tree.visits(x[q], 3) == order[:3]
