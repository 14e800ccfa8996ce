"""Long texts are measured in pieces: the same figures, bounded memory."""

import os
import random
import subprocess
import sys

import pytest

from conftest import ROOT
from packetloom.llm import fertility

PEAK = """
import random, re, sys
sys.path.insert(0, {root!r})
import public_tokenizers
from packetloom.llm import fertility

def peak():
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10

rng = random.Random(1)
words = ["".join(rng.choice("abcdefghiéü漢") for _ in range(rng.randrange(2, 10))) for _ in range(50_000)]
part = "\\n".join(" ".join(rng.choices(words, k=30)) for _ in range(10_000)).encode() + b"\\n"
text = bytearray()
while len(text) < 100 << 20:
    text += b"%d " % len(text) + part
lexicon = fertility.Lexicon([public_tokenizers.path(v) for v in fertility.VOCABULARIES])
before = peak()
found = fertility.measure_long(lexicon, memoryview(text))
print(found[0][0], peak() - before)
"""


@pytest.fixture(scope="module")
def lexicon():
    import public_tokenizers

    return fertility.Lexicon([public_tokenizers.path(v) for v in fertility.VOCABULARIES])


@pytest.mark.parametrize("limit", [1, 17, 300])
def test_pieces_give_the_whole(lexicon, monkeypatch, limit):
    monkeypatch.setattr(fertility.pieces, "__defaults__", (limit,))
    rng = random.Random(limit)
    words = ["wort", "été", "漢字", "a", "#b%", "\x85", "naïve", "<x>"]
    texts = ["", " ", "a", "a b c d e " * 40, "x\n\n \nx\nx", "漢" * 500, " lead", "trail \n"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t\n", "  "]) for _ in range(rng.randrange(200))) for _ in range(40)]
    for t in texts:
        whole = [list(x)[0] for x in fertility.measure(lexicon, [t])]
        cut = [x[0] for x in fertility.measure_long(lexicon, memoryview(t.encode()))]
        assert cut[:6] == whole[:6], t
        assert cut[6:] == pytest.approx(whole[6:], abs=1e-9)


def test_a_cleared_lexicon_changes_nothing(lexicon, monkeypatch):
    monkeypatch.setattr(fertility.pieces, "__defaults__", (100,))
    body = memoryview(" ".join(f"w{i % 37} v{i}" for i in range(2000)).encode())
    want = fertility.measure_long(lexicon, body)
    monkeypatch.setattr(fertility, "CACHE", 20)
    assert fertility.measure_long(lexicon, body) == want


def test_long_rows_take_the_same_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three " * 100_000, "en"), (2, "short text", "en"), (3, None, None)], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in fertility.measures(docs).collect()}
    assert rows[1]["n_words"] == 300_000 and rows[1]["n_repeat_words"] == 300_000 and rows[1]["script"] == "Latin"
    assert rows[2]["n_words"] == 2 and rows[3]["n_words"] == 0


def test_memory_of_a_text_of_100_mb():
    """Some 13 million words: 8 bytes each for their windows, and what sorting a part of these takes."""
    run = subprocess.run([sys.executable, "-c", PEAK.format(root=ROOT)], capture_output=True, text=True, timeout=600, env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert run.returncode == 0, run.stderr[-800:]
    n_words, grown = map(int, run.stdout.split())
    assert n_words > 10_000_000
    assert grown < 400
