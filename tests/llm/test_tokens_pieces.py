"""Texts of common characters are cut into pieces as the library cuts them, each different piece encoded once."""

import random
import re

from packetloom.llm import tokens


class Watched:
    """A tokenizer that counts the strings that go through all of it."""

    def __init__(self, inner):
        self.inner, self.whole = inner, 0

    def encode_batch_fast(self, batch, *a, **k):
        self.whole += len(batch)
        return self.inner.encode_batch_fast(batch, *a, **k)

    def __getattr__(self, name):
        return getattr(self.inner, name)


def test_kinds_of_characters():
    library = tokens._tokenizer(None)
    every = [chr(i) for i in range(0x3FFFF) if not 0xD800 <= i < 0xE000]
    letters = re.findall(f"[{tokens.LETTERS}]", "".join(every))
    marks = re.findall(f"[{tokens.MARKS}]", "".join(every))
    spaces = re.findall(f"[{tokens.SPACES}]", "".join(every))
    assert len(letters) > 30_000 and len(marks) > 60 and spaces == list("\t\n\v\f\r \xa0　")
    for text in (" ".join(f"a{c}a" for c in letters), " ".join(f"!{c}!" for c in marks), "".join(f"a{c}b{c}{c} {c}1" for c in spaces)):
        want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert tokens.Counter(library).pieces(text) == want


def test_common_texts_skip_the_whole_library():
    library = Watched(tokens._tokenizer(None))
    rng = random.Random(3)
    words = ["plain", "Don't", "we'll,", "x'y'", "'S", "12", "über", "東京。", "two\n\n\nlines", "a \n b", "\t", "  ", "“so”—", "naïve…", "№", "🙂", "\x1c", " ", "<|endoftext|>", "<|", "z" * 90]
    counter = tokens.Counter(library)
    for _ in range(400):
        text = rng.choice([" ", "", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(1, 40)))
        assert counter([text, "", text]) == [n := len(library.encode(text, add_special_tokens=False)), 0, n]
    library.whole = 0
    new = [f"{a}{b}{c}" for a in ("ver", "ges") for b in ("mol", "tak") for c in (".", ",\nThe", "!!", "'s", " 3?", "\n\n\n\n(x)")]
    assert counter(new) == [len(library.encode(t, add_special_tokens=False)) for t in new]
    assert library.whole == 0


def test_another_rule_goes_through_the_library():
    from tokenizers import pre_tokenizers

    library = tokens._tokenizer(None)
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    text = "in 1999 and 2024, 100000 words"
    counter = tokens.Counter(library)
    assert counter.pieces(text) is None
    assert counter([text]) == [len(library.encode(text, add_special_tokens=False))]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    library = tokens._tokenizer(None)
    texts = [" ".join(f"w{i}x{j}" for j in range(8)) + " № " + "y" * 100 for i in range(5)]
    counter = tokens.Counter(library)
    assert counter(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]
    assert max(len(counter.merged), len(counter.known)) <= 5
    assert max(map(len, [*counter.merged, *counter.known])) <= tokens.REMEMBERED
