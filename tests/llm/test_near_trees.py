"""Near dedup searches SimHash fingerprints in BK-trees; bands and the exact check come beside and after."""

import random

import corpus_pipeline
from packetloom.llm import jaccard, simhash
from pyspark.sql import functions as F


def edited(seed):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    other = words[:]
    other[150] = "changed"
    return " ".join(words), " ".join(other)


def test_trees_propose_near_copies(spark, monkeypatch):
    """With no bands at all, trees and the exact check find copies with few bits changed."""
    searched, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: searched.append(a[2]) or links(*a, **k))
    texts = [t for seed in range(6) for t in edited(seed)] + ["", None, "one two"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {0, 2, 4, 6, 8, 10, 12, 14}
    assert searched == [14]

    prints = {i: simhash.of_hashes(jaccard.shingles(t)) for i, t in enumerate(texts)}
    near = {(i, i + 1) for i in range(0, 12, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= jaccard.RADIUS}
    values = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items() if i != 13], "v long, fp long")
    found = jaccard.tree_links(spark, values).select(F.least("a", "b"), F.greatest("a", "b")).collect()
    assert near and {tuple(r) for r in found} == near
