"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
SMOOTHING = 0.5

MAX_LANGUAGES = 1000
"""The matrix is sent to every executor: at most this many rows of ``BUCKETS`` numbers (4 bytes each)."""

PIECE = 1 << 20
"""Characters looked at together."""

_MULTIPLY = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_letter = np.zeros(0, bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Letters stay, all else becomes 0."""
    global _letter
    if not len(_letter):
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(_letter[codes], codes, np.uint32(0))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every n-gram that holds a letter.

    Texts are lower-cased; runs of anything but letters end words. N-grams may begin or end
    with one word end, none spans two words.
    """
    parts, owners = [], []
    for i, t in enumerate(texts):
        if t:
            codes = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            parts += [np.zeros(1, np.uint32), codes]
            owners += [np.full(len(codes) + 1, i, np.int32)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    owner = np.concatenate([*owners, owners[-1][-1:]])
    found, whose = [], []
    for h, keep in _ngrams(np.concatenate([*parts, np.zeros(1, np.uint32)])):
        found.append(h[keep])
        whose.append(owner[: len(h)][keep])  # the mark before a text is its own, the one after it is not
    return np.concatenate(found), np.concatenate(whose)


def _ngrams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: the bucket of the n-gram from each place on, and whether it counts."""
    codes = _letters(codes)
    for n in ORDERS:
        views = [codes[k : len(codes) - n + 1 + k] for k in range(n)]
        h = np.full(len(views[0]), n, np.uint32)
        for k, v in enumerate(views):
            h = (h ^ v * _MULTIPLY[k]) * np.uint32(0x01000193)
        if n == 1:
            keep = views[0] != 0
        elif n == 2:
            keep = (views[0] != 0) | (views[1] != 0)
        else:
            keep = np.all([v != 0 for v in views[1:-1]], axis=0)
        yield ((h ^ (h >> np.uint32(15))) % BUCKETS).astype(np.int64), keep


def pieces(texts: list[str | None], size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, buckets of its n-grams), a text of over ``size`` characters in several turns.

    A piece goes on for the longest n-gram that begins in it, so each n-gram comes once.
    """
    for i, t in enumerate(texts):
        if len(t or "") <= size:
            yield i, buckets([t])[0]
            continue
        lower = t.lower()
        for at in range(0, len(lower) + 2, size):  # places with the word ends around the text
            after = at + size + ORDERS[-1] - 1
            part = lower[max(at - 1, 0) : after - 1]
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.pad(codes, (int(at == 0), int(after > len(lower) + 1)))
            yield i, np.concatenate([h[:size][keep[:size]] for h, keep in _ngrams(codes)])


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray
    """Log probabilities, one row per bucket."""
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its posterior share per text. Ties go to the first name."""
        totals = np.tile(self.prior, (len(texts), 1))
        if any(len(t or "") > PIECE for t in texts):
            for i, b in pieces(texts):
                totals[i] += self.logs[b].sum(axis=0, dtype=np.float64)
        else:
            b, owner = buckets(texts)
            for k in range(len(self.languages)):
                totals[:, k] += np.bincount(owner, self.logs[b, k], len(texts))
        names, scores = [], []
        for t, row in zip(texts, totals, strict=True):
            if not self.languages or not has_letter(t):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(row.argmax())
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(row - row[best]).sum()))
        return names, scores


def fit(docs: DataFrame, train: Column | None = None, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows with a language for which ``train`` holds.

    Every task counts into one matrix and reports its non-zero cells; sums over tasks are
    bounded by languages times ``BUCKETS``. Null texts and languages teach nothing. With no
    rows the model knows no language.
    """
    rows = docs.where(F.col(lang).isNotNull() & (train if train is not None else F.lit(True)))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("text is not null")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            names, bodies = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
            for name in sorted(set(names.tolist())):
                own = cells.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                for _, b in pieces([t for t, n in zip(bodies, names, strict=True) if n == name]):
                    own[:BUCKETS] += np.bincount(b, minlength=BUCKETS)
                own[BUCKETS] += int((names == name).sum())
        for name, own in cells.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the matrix would not fit")
    counts = np.zeros((len(languages), BUCKETS + 1))
    number = {name: i for i, name in enumerate(languages)}
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))  # BUCKETS + 1 cells at most
    for r in packed.toLocalIterator():
        for bucket, n in r["cells"]:
            counts[number[r["lang"]], bucket] = n
    grams = counts[:, :BUCKETS] + SMOOTHING
    logs = np.log(grams / grams.sum(axis=1, keepdims=True)) if languages else np.zeros((0, BUCKETS))
    prior = np.log(np.maximum(counts[:, BUCKETS], 1) / max(counts[:, BUCKETS].sum(), 1)) if languages else np.zeros(0)
    return Model(languages, np.ascontiguousarray(logs.T.astype(np.float32)), prior)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row from its whole text; ``und`` and 0 for a text
    that is null or has no letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, limit=1 << 20):
            names, scores = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")
