"""Conversation repair against plain loops over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from packetloom.llm import turns

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def search(codes):
    """Least (cost, audit) over all edits, by plain recursion."""

    @lru_cache(None)
    def go(i, at, inserted):
        ways = [(0, "")] if i == len(codes) and at in (0, 2) else []
        if inserted < 3:
            c, a = go(i, 2 if at == 3 else 3, inserted + 1)
            ways.append((c + 5, "I" + a))
        if i < len(codes):
            c, a = go(i + 1, at, 0)
            ways.append((c + 2, "D" + a))
            role, extra = codes[i].lower(), 5 if codes[i].isupper() else 0
            if role != "x":
                if at == 0 and role == "s":
                    c, a = go(i + 1, 1, 0)
                    ways.append((c + extra, "K" + a))
                wanted = "a" if at == 3 else "u"
                c, a = go(i + 1, 2 if at == 3 else 3, 0)
                ways.append((c + extra, "K" + a) if role == wanted else (c + extra + 1, "R" + a))
        return min(ways) if ways else (10**9, "")

    return go(0, 0, 0)


def folded(codes, cuts):
    """The same from segments cut at ``cuts``."""
    parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
    to_go = [turns.END_COST]
    for p in reversed(parts):
        m = turns.price(p)
        to_go.append(tuple(min(m[4 * e + f] + to_go[-1][f] for f in range(4)) for e in range(4)))
    at, audit = turns.START, ""
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        _, at, piece = turns.align(p, at, to_go[len(parts) - 1 - k], turns.END_AUDIT if last else ("",) * 4)
        audit += piece
    return to_go[-1][turns.START], audit


@pytest.mark.parametrize("letters", ["ua", "uas", "uaUAx", "suaoxSUAO", "uuuax", "u", "a", "x", "xS", "sS"])
def test_alignment_is_the_cheapest_and_first(letters):
    rng = random.Random(letters)
    for _ in range(300):
        n = rng.randrange(1, 14)
        codes = "".join(rng.choice(letters) for _ in range(n))
        cuts = sorted(rng.sample(range(1, n), rng.randrange(0, min(3, n)))) if n > 1 else []
        assert folded(codes, cuts) == search(codes), (codes, cuts)


def test_long_alignment():
    rng = random.Random(8)
    codes = "".join(rng.choice("uuuaaaxUAso") if rng.random() < 0.3 else "ua"[i % 2] for i in range(150))
    want = search(codes)
    assert folded(codes, []) == want
    assert folded(codes, [10, 70, 71]) == want


def edits(rows):
    """[(conv_id, turn, role, text)] after damage."""
    out = []
    for c, t, role, text in rows:
        role, text = [" " if x is None else x for x in (role, text)]
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in edits(rows):
        own[c].append((t is not None, t or 0, role, text))
    out = []
    for c in {r[0] for r in rows}:
        seen, codes, counts, told = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}, sorted(own[c])
        for _, _, role, text in told:
            ends = BLANK.findall(text)
            kind = "blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else ""
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if kind in ("blank", "duplicate") else letter.upper() if kind else letter
            if kind:
                counts[kind] += 1
        numbers = [t for known, t, _, _ in told if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        wrong = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit = search(codes)
        left, said = iter(told), []
        for e in audit:
            expected = "assistant" if said and said[-1].startswith("u") else "user"
            if e == "I":
                said.append(f"{expected}:")
                continue
            _, _, role, text = next(left)
            if e != "D":
                said.append(f"{role if e == 'K' else expected}:{text}")
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.append((c, gaps, *counts.values(), wrong, cost, audit, digest))
    return sorted(map(repr, out))


def conversations():
    """Clean and broken ones, ties, repeated rows, odd roles, nulls in any column, one long conversation."""
    rng = random.Random(12)
    texts = ["Yes.", "No!", "Why? ", "and then", "", " \t", None, "Fine.\n", "é.", "a\nb.", "x" * 3000 + "."]
    out = []
    for c in range(120):
        n = rng.randrange(1, 10)
        for t in range(n):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(["system", "user", "assistant", "tool", "", None, "User"])
            body = f"Turn {t} of it." if rng.random() < 0.6 else rng.choice(texts)
            out.append((c, t if rng.random() < 0.95 else rng.choice([None, 0, t + 3]), role, body))
    for t in range(100):
        out.append((500, t, ("user", "assistant")[t % 2], f"Long {t if t % 7 else 0}." if t % 5 else "cut off"))
    out += [(501, None, None, None), (None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, "system", "Be."), out[3], out[3], out[40]]
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*out, (dropped, 0, "user", "Gone.")]


@pytest.mark.parametrize("bits", [turns.SEGMENT_BITS, 3])
def test_repair(spark, monkeypatch, bits):
    monkeypatch.setattr(turns, "SEGMENT_BITS", bits)
    rows = conversations()
    clash = "conv_id long, turn long, role string, text string, conv string, at string, seg long, fault int, audit long, cost string"
    table = spark.createDataFrame([(*r, "c", "a", 1, 2, 3, "k") for r in rows], clash).repartition(3)
    found = [tuple(r) for r in turns.repair(spark, turns.damaged(table), table).collect()]
    want = brute(rows)
    assert sorted(map(repr, found)) == want
    assert any(r[5] for r in found) and any("R" in r[7] for r in found)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair(spark, turns.damaged(none), none).collect() == []
