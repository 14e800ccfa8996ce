"""Passages that begin and end anywhere, against a loop over all windows."""

import random
import re
from collections import defaultdict

import duckdb
import pytest

from packetloom.llm import passages, queries

WORD = re.compile(r"[^\W_]+")


def loop(docs, words):
    """By document (id and text): words, covered words, longest run of them, spans."""
    found, at = {d: list(WORD.finditer(d[1] or "")) for d in docs}, defaultdict(set)
    windows = {d: [tuple(m[0].lower() for m in w[i : i + words]) for i in range(len(w) - words + 1)] for d, w in found.items()}
    for d, own in windows.items():
        for w in own:
            at[w].add(d)
    out = {}
    for d, own in windows.items():
        hit = sorted({i + k for i, w in enumerate(own) if len(at[w]) > 1 for k in range(words)})
        runs = []
        for i in hit:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        spans = [(found[d][a].start(), found[d][b].end()) for a, b in runs]
        out[d] = (len(found[d]), len(hit), max((b - a + 1 for a, b in runs), default=0), spans)
    return out


def rows():
    rng = random.Random(3)
    vocabulary = ["wort", "mot", "Straße", "été", "niño", "İstanbul", "42", "河", "x1", *(f"w{i}" for i in range(300))]
    text = lambda n, sep=" ": sep.join(rng.choice(vocabulary) for _ in range(n))
    passage = [rng.choice(vocabulary) for _ in range(50)]
    out = [
        (0, f"{text(9)} {' '.join(passage)} {text(12)}"),  # inside a line
        (1, f"{text(30)}\n{' '.join(passage[:20])}\n{' - '.join(passage[20:])}, {text(3)}"),  # across lines
        (2, f"{text(20)} {' '.join(passage[:49])} other {text(20)}"),  # a word short
        (3, " ".join(passage).upper()),
        (4, " ".join(passage * 2) + " " + " ".join(passage)),
        (5, text(49)),
        (6, ""),
        (7, None),
        (8, " \n_ "),
        (None, f"{text(40)} {text(60)}"),
    ]
    base = text(200).split()
    for i in range(9, 20):  # edited copies
        edited = list(base)
        for _ in range(i % 4):
            edited[rng.randrange(200)] = f"n{rng.randrange(99)}"
        out.append((i, "\n".join(" ".join(edited[k : k + 23]) for k in range(0, 200, 23))))
    own = text(70)
    out += [(20, own), (20, own), (21, own.upper() + "!"), (22, f"({own})"), (23, f"a {own} b"), (24, text(80)), (24, out[0][1]), (None, None)]
    twice = text(60)
    out += [(25, f"{twice} z {twice}"), (26, text(90)), (26, text(90))]
    out.append(out[-2])
    return out


@pytest.mark.parametrize("words", [50, 1, 2, 7, 64])
def test_passages_are_found_wherever_lines_end(spark, monkeypatch, words):
    monkeypatch.setattr(passages, "AT_ONCE", 16)
    monkeypatch.setattr(passages, "LONG", 900)
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    want = loop(set(rows()), words)
    found = passages.repeated_passages(spark, docs, words).collect()
    got = [(r["doc_id"], r["n_words"], r["n_passage_words"], r["longest_passage"], [tuple(p) for p in r["passages"]]) for r in found]
    assert sorted(got, key=repr) == sorted([(d[0], *want[d]) for d in rows()], key=repr)


def test_whole_lines_miss_what_passages_tell(spark):
    """What a passage of 60 words inside lines and across them looks like to the two operators."""
    words = [f"p{i}" for i in range(60)]
    texts = [f"before {' '.join(words)} after", "\n".join([" ".join(words[:25]), " ".join(words[25:])]), " ".join(f"q{i}" for i in range(90))]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    lines = {r["doc_id"]: r["longest_repeated"] for r in passages.dedup_units(spark, docs, min_words=8).collect()}
    found = {r["doc_id"]: r["longest_passage"] for r in passages.repeated_passages(spark, docs).collect()}
    assert lines == {0: 0, 1: 0, 2: 0}
    assert found == {0: 60, 1: 60, 2: 0}


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert passages.repeated_passages(spark, none).collect() == []


def test_the_query_tells_what_whole_lines_miss(spark, tmp_path):
    """Three holders of a passage of 60 words, inside a line, across lines and doubled, of which the query on lines tells none."""
    words = [f"p{i}" for i in range(60)]
    texts = [f"Before: {' '.join(words)}, after", "\n".join([" ".join(words[:25]).upper(), " ".join(words[25:])]), f"a {' '.join(words)}\nb {' '.join(words)} c"]
    texts += [f"{' '.join(words[:49])} other", " ".join(f"q{i}" for i in range(90)), None, ""]
    table = [*enumerate(texts), (4, texts[4])]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = queries.QUERIES["op2_substring_dedup"](spark, str(tmp_path)).where("repeats_passage")
    found = queries.QUERIES["repeated_passages"](spark, str(tmp_path))
    assert lines.count() == 0
    got = sorted(tuple(r) for r in found.collect())
    ends = [re.search("p0.*p59", t, re.S | re.I).span() for t in texts[:2]] + [m.span() for m in re.finditer("p0 .*p59", texts[2])]
    spans = [":".join(map(str, e)) for e in ends]
    told = [(0, 62, 60, 60, True, spans[0]), (1, 60, 60, 60, True, spans[1]), (2, 123, 120, 60, True, ",".join(spans[2:]))]
    assert got == [*told, (3, 50, 0, 0, False, ""), (4, 90, 0, 0, False, ""), (4, 90, 0, 0, False, ""), (5, 0, 0, 0, False, ""), (6, 0, 0, 0, False, "")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(queries.ORACLES["repeated_passages"]).fetchall()) == got
    assert found.columns == [c[0] for c in con.description]
