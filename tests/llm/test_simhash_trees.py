"""Shards of fingerprints that are large enough for trees, and shards cut level by level."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import simhash


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_every_level_covers_every_link(radius):
    rng = random.Random(radius)
    for n in (0, 1, 5_000, 10**7, 10**11):
        for keys in simhash.key_levels(n, radius):
            for _ in range(100):
                flipped = set(rng.sample(range(64), radius))
                assert any(not any(a <= b < c for a, c in key for b in flipped) for key in keys)


def test_first_shards_keep_their_size():
    for n in (10**4, 10**6, 10**8, 10**10):
        width = sum(b - a for a, b in simhash.shard_keys(n)[0])
        assert simhash.TREE_ROWS / 2 <= n / 2**width <= simhash.TREE_ROWS


def signed(values):
    return [(int(np.uint64(v).view(np.int64)),) for v in values]


def test_trees_carry_the_search(spark):
    """Random fingerprints and copies of some with up to three bits changed, in shards of thousands."""
    rng = random.Random(8)
    values = {rng.getrandbits(64) for _ in range(6_000)}
    near = {v: v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))) for v in rng.sample(sorted(values), 300)}
    every = sorted(values | set(near.values()))
    df = spark.createDataFrame(signed(every), "fp long")
    shards = df.select(F.explode(F.array(*[simhash._bits(F.col("fp"), k) for k in simhash.shard_keys(len(every))])).alias("s"))
    assert shards.groupBy("s").count().agg(F.min("count")).first()[0] > 1_000
    found = simhash.links(spark, df, len(every))
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(spark, found).collect()}
    assert all(roots.get(a, a) == roots.get(b, b) for a, b in near.items())
    assert set(roots) | set(roots.values()) == set(near) | set(near.values())


def test_hot_shards_go_down_the_levels(spark):
    """A ball around one value fills one shard of every coarse key; a chain crosses its edge."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    ball = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3))) for _ in range(900)}
    chain = [centre ^ sum(1 << b for b in range(k)) for k in range(0, 64, 3)]
    apart = {rng.getrandbits(64) for _ in range(300)}
    every = sorted(ball | set(chain) | apart)
    found = simhash.links(spark, spark.createDataFrame(signed(every), "fp long"), len(every), shard_rows=100)
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(spark, found).collect()}
    assert len({roots.get(v, v) for v in ball | set(chain)}) == 1
    assert all(v not in roots for v in apart)
