"""Fill-in-the-middle against plain loops."""

import hashlib
import random
import re
from collections import Counter

import pytest

from packetloom.llm import fim

LETTERS = ["a", "b ", " ", "\n", "é", "<", "P", ">", "S", "<P", "漢", "\x85", "\x1c", "\t", "😀"]


def brute(i, text, seed=42):
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, t, t
    if h[3] % 100 < 80:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = [(i, "".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 30)))) for i in range(2000)]
    odd = [None, "", "<P>", "a <M> b", " ", "x " * 200_000, "y\n" * 3 + "é" * 300_000]
    return out + list(enumerate(odd, len(out))) + [(None, "without an id"), (None, None), out[7], out[7]]


def test_fill_in_middle(spark, texts):
    """Odd letters, marks, nulls, empty and long texts, repeated rows, clashing columns."""
    clash = "doc_id long, text string, form string, _h1 string, restored string, n string"
    docs = spark.createDataFrame([(*r, "f", "h", "r", "n") for r in texts], clash).repartition(3)
    found = [tuple(r) for r in fim.fill_in_middle(docs, check=True).collect()]
    assert sorted(map(repr, found)) == sorted(repr(brute(*r)) for r in texts)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_seed_and_names(spark, texts):
    docs = spark.createDataFrame(texts[:200], "key long, body string")
    found = fim.fill_in_middle(docs, seed=7, doc_id="key", text="body")
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute(*r, seed=7)[:6] for r in texts[:200])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(docs, check=True).collect() == []
