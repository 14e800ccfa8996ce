"""Long texts are counted in pieces, every n-gram once."""

import numpy as np
import pytest

from packetloom.llm import langid


@pytest.mark.parametrize("size", [3, 4, 7, 50])
def test_pieces_count_what_the_whole_text_has(size):
    texts = ["", None, "a", "ab", "Straße İstanbul ΟΔΟΣ ΟΔΟΣ, x", "aaa " * 40, "x" * 101, " .", "é😀日本語のテキスト" * 5, "abcdefg", "abcdef"]
    for i, text in enumerate(texts):
        whole = np.bincount(langid.buckets([text])[0], minlength=langid.BUCKETS)
        got = np.zeros(langid.BUCKETS, np.int64)
        for owner, b in langid.pieces([text], size):
            assert owner == 0
            got += np.bincount(b, minlength=langid.BUCKETS)
        assert (got == whole).all(), (i, size)


def test_predictions_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(langid.BUCKETS), 3)).T.astype(np.float32)
    model = langid.Model(["a", "b", "c"], np.ascontiguousarray(logs), np.zeros(3))
    texts = ["the quick brown fox " * 30, "short", None, "Donaudampfschiff " * 50]
    whole = model.predict(texts)
    monkeypatch.setattr(langid, "PIECE", 64)
    monkeypatch.setattr(langid.pieces, "__defaults__", (64,))
    cut = model.predict(texts)
    assert cut[0] == whole[0] and np.allclose(cut[1], whole[1], atol=1e-3)
