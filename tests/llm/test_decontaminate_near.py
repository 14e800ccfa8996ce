"""Exact phrases and proximity matches side by side, against plain loops."""

import random
from collections import Counter

import pytest

from packetloom.llm import decontaminate

SLOP = 2


def brute(texts, items, window):
    cut = {}
    for i, t in items:
        w = decontaminate.words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            cut.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for doc_id, t in texts:
        w = decontaminate.words(t)
        exact, near, exact_items, near_items = set(), set(), set(), set()
        for p, names in cut.items():
            for s in range(len(w)):
                if tuple(w[s : s + len(p)]) == p:
                    exact.update(range(s, s + len(p)))
                    exact_items |= names
                run = range(s, min(s + len(p) + SLOP, len(w)))
                if not Counter(p) - Counter(w[k] for k in run):
                    near.update(run)
                    near_items |= names
        out.append((doc_id, len(w), len(exact), sorted(exact_items), len(near), sorted(near_items)))
    return out


@pytest.mark.parametrize("at_once, block_words", [(200_000, 1 << 20), (2, 60)])
def test_exact_and_near(spark, at_once, block_words):
    rng = random.Random(12)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(n))) for i, n in enumerate([5, 4, 7, 2, 1, 5])] + [(90, None), (91, ""), (0, "x y z x y")]
    texts = [(i, " ".join(rng.choice("abcdefghxyz") for _ in range(rng.randrange(40)))) for i in range(60)]
    texts += [(100, items[2][1]), (101, None), (102, ""), (103, "z y x x y"), (103, "z y x x y"), (None, items[0][1].upper()), (104, "x y z y"), (105, "x q y z q x y x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(spark, docs, bench, window=4, slop=SLOP, at_once=at_once, block_words=block_words)
    got = [(r["doc_id"], r["n_words"], r["n_exact"], r["exact_items"], r["n_hit"], r["items"]) for r in found.collect()]
    want = brute(texts, items, 4)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(w[2] < w[4] for w in want) and any(w[3] != w[5] for w in want)
    plain = decontaminate.decontaminate(spark, docs, bench, window=4, at_once=at_once, block_words=block_words)
    assert sorted(repr((r["doc_id"], r["n_hit"], r["items"])) for r in plain.collect()) == sorted(repr((w[0], w[2], w[3])) for w in want)
