"""Toxicity: a linear classifier that must not care which group a sentence mentions.

Labelled texts with identity terms are paired with copies in which the terms are swapped
for others of their kind; training penalises the squared change of the score, so the
weight of a bare group mention goes to zero while insults keep theirs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import slices

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)

IDENTITY = (
    # Terms of one row may stand for each other.
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish", "turkish", "polish"),
    ("immigrant", "refugee", "foreigner", "citizen", "native"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten"),
    ("ausländer", "einwanderer", "flüchtlinge", "deutsche"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"),
    ("étrangers", "immigrés", "réfugiés", "français"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas"),
    ("extranjeros", "inmigrantes", "refugiados", "españoles"),
)
KIN = {t: [o for o in row if o != t] for row in IDENTITY for t in row}

BUCKETS = 1 << 20
SAMPLE = 10_000
"""Labelled rows of each class used for fitting, at most; those with the smallest hashed ids."""

FEATURES = 8192
"""Buckets kept for the model, the most telling ones of the sample."""

SWAPS = 2
FAIRNESS = 4.0
L2 = 1e-4
ROUNDS = 300


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its beginnings."""
    parts = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def words(text: str | None) -> Counter[str]:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def swapped(own: Counter[str], turn: int) -> Counter[str] | None:
    """The words with every identity term replaced by another of its kind; None without terms."""
    if not (own.keys() & KIN.keys()):
        return None
    out: Counter[str] = Counter()
    for w, n in own.items():
        kin = KIN.get(w)
        out[kin[(turn * 3 + len(w)) % len(kin)] if kin else w] += n
    return out


class Vectors:
    """Sparse rows over chosen buckets: logarithms of counts. Words are looked up once."""

    def __init__(self, buckets: np.ndarray):
        self.number = {int(b): i for i, b in enumerate(buckets)}
        self.known: dict[str, list[int]] = {}

    def row(self, own: Counter[str]) -> dict[int, float]:
        counts: dict[int, int] = {}
        for w, n in own.items():
            at = self.known.get(w)
            if at is None:
                if len(self.known) > 500_000:
                    self.known.clear()
                at = self.known[w] = [self.number[b] for b in features(w) if b in self.number]
            for i in at:
                counts[i] = counts.get(i, 0) + n
        return {i: float(np.log1p(n)) for i, n in counts.items()}


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: Iterable[str | None], vectors: Vectors) -> list[float]:
        out = []
        for t in texts:
            z = self.bias + sum(v * self.weights[i] for i, v in vectors.row(words(t)).items())
            out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return out


def descend(rows: list[dict[int, float]], labels: np.ndarray, cost: np.ndarray, gaps: list[dict[int, float]], size: int, fairness: float) -> tuple[np.ndarray, float]:
    """Minimise weighted log loss + L2 + ``fairness`` times the mean squared score change of ``gaps``."""

    def flat(own: list[dict[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = np.repeat(np.arange(len(own)), [len(x) for x in own])
        return r, np.fromiter((i for x in own for i in x), np.int64, len(r)), np.fromiter((v for x in own for v in x.values()), np.float64, len(r))

    (r, c, v), (gr, gc, gv) = flat(rows), flat(gaps)
    w, b = np.zeros(size), 0.0
    m, s = np.zeros(size + 1), np.zeros(size + 1)
    total = cost.sum()
    for t in range(1, ROUNDS + 1):
        z = np.bincount(r, v * w[c], len(rows)) + b
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * cost / total
        g = np.bincount(c, v * off[r], size) + 2 * L2 * w
        if gaps:
            change = np.bincount(gr, gv * w[gc], len(gaps))
            g += fairness * 2 * np.bincount(gc, gv * change[gr], size) / len(gaps)
        g = np.append(g, off.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column | None = None,
    fairness: float = FAIRNESS,
    sample: int = SAMPLE,
    n_features: int = FEATURES,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """A model from at most ``sample`` labelled rows of each class for which ``train`` holds.

    The sample is bounded by its parameter, so it is broadcast to find its texts, and its
    chosen features (``n_features`` buckets) come to the driver. Rows count as often as the
    rows of their class that they stand for. Null labels, ids and texts teach nothing; without
    both classes the model is the share of toxic rows (0.05 with no rows at all).
    """
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if train is not None:
        known = known.where(train)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        p = min(max(float(max(sizes, default=0)), 0.05), 0.95)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(p / (1 - p))))
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").select("y", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches):
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts[y][list({b for w in words(t) for b in features(w)})] += 1
        at = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["b", "n0", "n1"])

    seen = chosen.mapInArrow(count, "b long, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    drawn = {y: min(n, sample) for y, n in sizes.items()}
    lean = F.log((F.col("n1") + 0.5) / (drawn[1] + 1)) - F.log((F.col("n0") + 0.5) / (drawn[0] + 1))
    told = F.abs(lean) * F.sqrt(F.col("n0") / drawn[0] + F.col("n1") / drawn[1])
    top = seen.where("n0 + n1 >= 3").orderBy(told.desc(), "b").limit(n_features).collect()
    terms = {b for t in KIN for b in features(t)}
    buckets = np.array(sorted({r["b"] for r in top} | terms), np.int64)

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vectors(buckets)
        for batch in slices(batches):
            rows = []
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words(t)
                rows.append((y, 0, own.row(w)))
                for turn in range(SWAPS):
                    if (other := swapped(w, turn)) is not None:
                        rows.append((y, 1 + turn, own.row(other)))
            packed = [np.array([*x.keys()], "<i4").tobytes() for _, _, x in rows]
            values = [np.array([*x.values()], "<f4").tobytes() for _, _, x in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array(packed, pa.binary()), pa.array(values, pa.binary())],
                names=["y", "turn", "at", "value"],
            )

    rows, gaps, y, last = [], [], [], {}
    for r in chosen.mapInArrow(vectors, "y int, turn int, at binary, value binary").toLocalIterator():
        x = dict(zip(np.frombuffer(r["at"], "<i4").tolist(), np.frombuffer(r["value"], "<f4").tolist(), strict=True))
        if r["turn"] == 0:
            rows.append(x)
            y.append(r["y"])
            last = x
        else:
            gaps.append({i: last.get(i, 0.0) - x.get(i, 0.0) for i in last.keys() | x.keys() if last.get(i, 0.0) != x.get(i, 0.0)})
    if not rows:
        p = sizes[1] / (sizes[0] + sizes[1])
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(p / (1 - p))))
    labels_of = np.array(y, np.float64)
    cost = np.where(labels_of == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
    w, b = descend(rows, labels_of, cost, gaps, len(buckets), fairness)
    return Model(buckets, w, b)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every row from its whole text; null and empty texts get the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        vectors = Vectors(own.buckets)
        for batch in slices(batches):
            got = own.scores(batch.column("text").to_pylist(), vectors)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, f"doc_id {kind}, score double")
