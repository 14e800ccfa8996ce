"""Chunks of huge texts use the parts that ordinary texts use, where spaces allow it."""

import random

from packetloom.llm import tokens


class Watched:
    """A tokenizer that counts whole encodings."""

    def __init__(self, inner):
        self.inner, self.whole = inner, 0

    def encode(self, *a, **k):
        self.whole += 1
        return self.inner.encode(*a, **k)

    def __getattr__(self, name):
        return getattr(self.inner, name)


def spliced(library, text, counter):
    own = tokens.cut(text, 400, 80)
    return tokens.splice([tokens.report(library, p, at, at == own[-1][0], 80, counter) for at, p in own])


def test_chunks_count_by_parts():
    library = Watched(tokens._tokenizer(None))
    rng = random.Random(1)
    words = ["plain", "words", "Don't", "12345", "über", "  two", "\n\nline", "\tx", "東京", "🙂", "<|endoftext|>", "a" * 30]
    for _ in range(20):
        text = " ".join(rng.choice(words) for _ in range(600))
        library.whole = 0
        got = spliced(library, text, tokens.Counter(library))
        assert library.whole == 0
        assert got == len(library.inner.encode(text, add_special_tokens=False))


def test_chunks_without_spaces_are_encoded_whole():
    library = Watched(tokens._tokenizer(None))
    text = "東京都、大阪府。x1-" * 300
    got = spliced(library, text, tokens.Counter(library))
    assert library.whole > 0
    assert got == len(library.inner.encode(text, add_special_tokens=False))
