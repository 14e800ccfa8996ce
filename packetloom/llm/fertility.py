"""Quality rules from public vocabularies: how a tokeniser takes a text tells junk from prose.

Per document and vocabulary: characters per token, the share of byte-fallback tokens and
the entropy of its tokens. Bands come from the corpus, per language where there are enough
documents, else per script, else over all; documents outside a band are rejected.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.common import row_key, slices, stored

VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
MEASURES = ("chars_per_token", "byte_share", "entropy")

WIDTH = 4.0
"""A band reaches this many times as far from the median as the quartile on that side."""

MIN_GROUP = 200
"""Documents that a language or script needs for a band of its own."""

STEP = {"chars_per_token": 0.002, "byte_share": 0.001, "entropy": 0.005}
"""Grid on which the corpus is counted."""

LEAST = {"chars_per_token": 0.02, "byte_share": 0.01, "entropy": 0.05}
"""A quartile nearer to the median than this counts as so far."""

SHORT = (8.0, 80.0)
"""Short texts scatter more, and one odd word weighs more in them: bands are
``1 + SHORT[0] / sqrt(words) + SHORT[1] / words`` times as wide."""

CACHE, CACHE_BYTES = 200_000, 8 << 20
"""Words whose tokens a Python worker remembers, and bytes of them."""

PIECE_BYTES = 1 << 20
"""Bytes of text measured at once; longer texts go in pieces."""

MIN_WORDS, MAX_REPEAT = 10, 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
SPACE, LINE_END, BYTE_WORD, BYTE_SYMBOL = (re.compile(x) for x in (rb"[\x20\x09-\x0D]", rb"\n", rb"[^\x20\x09-\x0D]", rb"[#*$%&|<>]"))


def text_rules(text: str | None) -> tuple[int, int]:
    """Symbols, and lines with a word that equal an earlier line."""
    seen, n_dup = set(), 0
    for line in (text or "").split("\n"):
        if line in seen:
            n_dup += 1
        elif WORD.search(line):
            seen.add(line)
    return len(SYMBOL.findall(text or "")), n_dup


def repeats(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document in 5-word windows found twice or more in it, the first included.

    ``ids`` numbers the words of all documents in order, ``doc`` their documents. Windows
    are brought together by a hash and compared word by word.
    """
    n = len(ids) - 4
    if n < 2:
        return np.zeros(n_docs, np.int64)
    parts = [ids[k : n + k] for k in range(5)]
    h = doc[:n].astype(np.uint64)
    for part in parts:
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(doc[:n] == doc[4:])
    at = at[np.argsort(h[at], kind="stable")]
    a, b = at[:-1], at[1:]
    equal = h[a] == h[b]
    for part in (doc[:n], *parts):
        equal &= part[a] == part[b]
    change = np.zeros(len(ids) + 1, np.int64)
    twice = np.unique(np.concatenate([a[equal], b[equal]]))
    change[twice] += 1
    change[twice + 5] -= 1
    return np.bincount(doc, np.cumsum(change[:-1]) > 0, n_docs).astype(np.int64)


@lru_cache(4)
def load(path: str) -> tuple[Callable[[list[str]], list[list[int]]], np.ndarray]:
    """A function from words to their token ids, and which ids are byte fallback.

    Words are encoded with a space before them, as inside a text. Byte fallback: a byte
    piece, or for byte vocabularies a token that is no whole character.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        is_byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])
        return lambda words: model.encode(words, num_threads=1), is_byte
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    vocabulary = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    is_byte = np.zeros(max(ranks.values()) + 1, bool)
    for piece, i in ranks.items():
        try:
            piece.decode()
        except UnicodeDecodeError:
            is_byte[i] = True
    return lambda words: [vocabulary.encode_ordinary(" " + w) for w in words], is_byte


class Grown:
    """An array that is extended in place, doubling its room."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray | list[int]) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            room = np.zeros(max(n, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : n] = values
        self.n = n

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[: self.n][at]


class Tokens:
    """Per word of a lexicon: how many tokens, how many of byte fallback, and where they stand in ``flat``."""

    def __init__(self):
        self.sizes, self.starts, self.n_bytes, self.flat = Grown(np.int32), Grown(np.int64), Grown(np.int32), Grown(np.int32)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in order, and how many each word has."""
        own = self.sizes[ids].astype(np.int64)
        ends = np.cumsum(own)
        place = np.repeat(self.starts[ids] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[place], own


class Lexicon:
    """The words a worker has met, numbered, with what the measures need of each.

    It starts afresh beyond ``CACHE`` words or ``CACHE_BYTES``, so its memory is bounded.
    """

    def __init__(self, paths: list[str]):
        self.vocabularies = [load(p) for p in paths]
        self.scripts = ["none"]
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.n_bytes = 0
        self.chars, self.script, self.hash = Grown(np.int64), Grown(np.int64), Grown(np.uint64)
        self.tokens = [Tokens() for _ in self.vocabularies]

    def number(self, docs: list[list[bytes]]) -> np.ndarray:
        """Word numbers of all documents in one row."""
        new = set().union(*docs) - self.ids.keys()
        if len(self.ids) + len(new) > CACHE or self.n_bytes + sum(map(len, new)) > CACHE_BYTES:
            self._clear()
            new = set().union(*docs)
        if new:
            added = sorted(new)
            self.ids.update(zip(added, range(len(self.ids), len(self.ids) + len(added)), strict=True))
            self.n_bytes += sum(map(len, added))
            texts = [w.decode("utf-8", "replace") for w in added]
            self.chars.extend([len(t) for t in texts])
            self.script.extend([self._script(t[0]) for t in texts])
            self.hash.extend(np.array([xxhash.xxh64_intdigest(w) for w in added], np.uint64))
            for own, (encode, is_byte) in zip(self.tokens, self.vocabularies, strict=True):
                found = encode(texts)
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
                own.starts.extend(own.flat.n + np.cumsum(sizes) - sizes)
                own.sizes.extend(sizes)
                own.flat.extend(flat)
                own.n_bytes.extend(np.bincount(np.repeat(np.arange(len(found)), sizes), is_byte[flat], len(found)).astype(np.int64))
        return np.fromiter(map(self.ids.__getitem__, chain.from_iterable(docs)), np.int64)

    def _script(self, c: str) -> int:
        """Coarse script of a word by its first character: Latin, a block of 256 code points, or none."""
        if not c.isalpha():
            return 0
        name = "Latin" if ord(c) < 0x250 else f"U+{ord(c) >> 8:02X}00"
        if name not in self.scripts:
            self.scripts.append(name)
        return self.scripts.index(name)

    def script_counts(self, ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Words of each script per document."""
        n = len(self.scripts)
        return np.bincount(doc * n + self.script[ids], minlength=n_docs * n).reshape(n_docs, n)

    def script_of(self, counts: np.ndarray) -> list[str]:
        """Script of most words with one; ties go to the first name, ``none`` without any."""
        order = sorted(range(1, counts.shape[1]), key=self.scripts.__getitem__)
        if not order:
            return ["none"] * len(counts)
        best = np.array(order)[counts[:, order].argmax(axis=1)]
        return [self.scripts[k] if row[k] else "none" for k, row in zip(best, counts, strict=True)]

    def measures(self, i: int, ids: np.ndarray, doc: np.ndarray, n_docs: int) -> list[np.ndarray]:
        """Characters per token, byte share and entropy (bits) of each document under vocabulary ``i``."""
        flat, own = self.tokens[i].of(ids)
        n = np.bincount(doc, own, n_docs)
        some = np.maximum(n, 1)
        key = np.sort(np.repeat(doc.astype(np.int64), own) << 20 | flat)
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.diff(np.append(starts, len(key)))
        weighted = np.bincount(key[starts] >> 20, counts * np.log2(counts), n_docs)
        entropy = np.where(n > 0, np.log2(some) - weighted / some, 0.0)
        return [np.bincount(doc, self.chars[ids], n_docs) / some, np.bincount(doc, self.tokens[i].n_bytes[ids], n_docs) / some, np.abs(entropy)]


def measure(lexicon: Lexicon, bodies: list[str | None]) -> list[np.ndarray | list[str]]:
    """Columns of ``measures`` after the row's own: base counts, script, measures by vocabulary."""
    docs = [t.encode("utf-8", "replace").split() if t else [] for t in bodies]
    n_docs = len(docs)
    n_words = np.fromiter(map(len, docs), np.int64, n_docs)
    doc = np.repeat(np.arange(n_docs), n_words)
    ids = lexicon.number(docs)
    rules = np.array([text_rules(t) for t in bodies], np.int64).reshape(n_docs, 2)
    chars = np.bincount(doc, lexicon.chars[ids], n_docs).astype(np.int64)
    scripts = lexicon.script_of(lexicon.script_counts(ids, doc, n_docs))
    out = [n_words, chars, rules[:, 0].copy(), rules[:, 1].copy(), repeats(ids, doc, n_docs), scripts]
    for i in range(len(lexicon.vocabularies)):
        out += lexicon.measures(i, ids, doc, n_docs)
    return out


def pieces(text: memoryview, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``limit`` bytes that end where no word is cut."""
    at = 0
    while at < len(text):
        end = SPACE.search(text, min(at + limit, len(text)))
        to = end.start() if end else len(text)
        yield bytes(text[at:to])
        at = to


def n_dup_lines(text: memoryview) -> int:
    """Lines with a word that equal an earlier one, told apart by 128 bits each."""
    seen, at = bytearray(), 0
    while at <= len(text):
        end = LINE_END.search(text, at)
        to = end.start() if end else len(text)
        if BYTE_WORD.search(text, at, to):
            seen += xxhash.xxh128_digest(text[at:to])
        at = to + 1
    d = np.frombuffer(seen, "<u8").reshape(-1, 2)
    d = d[np.lexsort((d[:, 0], d[:, 1]))]
    return int((d[1:] == d[:-1]).all(axis=1).sum())


def mixed(words: np.ndarray) -> np.ndarray:
    """64 bits for each five words in a row."""
    h = np.zeros(max(len(words) - 4, 0), np.uint64)
    for k in range(5):
        h = (h ^ words[k : len(h) + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def n_repeated(windows: list[np.ndarray], n_words: int) -> int:
    """Words in windows that are there twice or more; windows are compared by their 64 bits,
    a sixteenth of them at a time."""
    starts = np.cumsum([0, *map(len, windows)])
    twice = np.zeros(n_words, bool)
    for part in range(16):
        own = [np.flatnonzero(w >> np.uint64(60) == part) for w in windows]
        h = np.concatenate([w[x] for w, x in zip(windows, own, strict=True)])
        at = np.concatenate([x + s for x, s in zip(own, starts[:-1], strict=True)])
        order = np.argsort(h, kind="stable")
        equal = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        twice[at[order[equal]]] = twice[at[order[equal + 1]]] = True
    covered = twice.copy()
    for k in range(1, 5):
        covered[k:] |= twice[:-k]
    return int(covered.sum())


def measure_long(lexicon: Lexicon, text: memoryview) -> list[list]:
    """What ``measure`` gives for one text, a piece of it at a time.

    Beyond the text, 8 bytes per word and 16 per line are held, and a count per token of a
    vocabulary: the sums, counts and windows of the pieces are those of the whole.
    """
    n_words = chars = n_symbols = 0
    tail = np.zeros(0, np.uint64)
    windows, scripts = [tail], np.zeros(1, np.int64)
    totals = [[np.zeros(len(is_byte), np.int64), 0] for _, is_byte in lexicon.vocabularies]
    for piece in pieces(text):
        words = piece.split()
        ids = lexicon.number([words])
        n_words += len(words)
        chars += int(lexicon.chars[ids].sum())
        n_symbols += len(BYTE_SYMBOL.findall(piece))
        own = lexicon.script_counts(ids, np.zeros(len(ids), np.int64), 1)[0]
        scripts = np.pad(scripts, (0, len(own) - len(scripts))) + own
        for tokens, total in zip(lexicon.tokens, totals, strict=True):
            total[0] += np.bincount(tokens.of(ids)[0], minlength=len(total[0]))
            total[1] += int(tokens.n_bytes[ids].sum())
        tail = np.concatenate([tail, lexicon.hash[ids]])
        windows.append(mixed(tail))
        tail = tail[max(len(tail) - 4, 0) :]
    out = [n_words, chars, n_symbols, n_dup_lines(text), n_repeated(windows, n_words), lexicon.script_of(scripts[None])[0]]
    for counts, n_bytes in totals:
        n = int(counts.sum())
        counts = counts[counts > 0]
        entropy = abs(np.log2(n) - float((counts * np.log2(counts)).sum()) / n) if n else 0.0
        out += [chars / max(n, 1), n_bytes / max(n, 1), entropy]
    return [[x] for x in out]


def measures(
    docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang"
) -> DataFrame:
    """Base counts, script and the measures of each vocabulary (``m0_chars_per_token``, ...) per row.

    Words are runs of other characters than ASCII white space, over whole texts. Null texts
    have none; without words all measures are 0. ``entropy`` is that of the document's token
    counts, in bits.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        lexicon = Lexicon([f"{folder}/{v}" if folder else public_tokenizers.path(v) for v in vocabularies])
        for batch in slices(batches, "text", PIECE_BYTES):
            columns = [batch.column(c) for c in ("doc_id", "lang", "_key1", "_key2")]
            body = batch.column("text")
            if (pc.max(pc.binary_length(body)).as_py() or 0) > PIECE_BYTES:  # it stands alone
                found = measure_long(lexicon, memoryview(body[0].as_buffer()))
            else:
                found = measure(lexicon, body.to_pylist())
            columns += [pa.array(c, kind) for c, kind in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = [pa.int64()] * 5 + [pa.string()] + [pa.float64()] * (len(vocabularies) * len(MEASURES))
    names = ["doc_id", "lang", "_key1", "_key2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script"]
    names += [f"m{i}_{m}" for i in range(len(vocabularies)) for m in MEASURES]
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, _key1 long, _key2 int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
    schema += ", ".join(f"{n} double" for n in names[10:])
    language = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), language.alias("lang"), *row_key(doc_id, text))
    return narrow.mapInArrow(work, schema)


def bands(measured: DataFrame, width: float = WIDTH, min_group: int = MIN_GROUP) -> DataFrame:
    """``level, name, measure, low, middle, high`` from all measured documents that pass the base rules.

    Counts on a fixed grid are combined in the map tasks; the quantiles are exact on it, so
    they depend on neither order nor partitioning. ``level`` 0: all, 1: script, 2: language.
    """
    columns = [c for c in measured.columns if re.match(r"m\d+_", c)]
    ok = measured.where(~_base_failed())
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("measure"), F.round(F.col(c) / STEP[c.split("_", 1)[1]]).cast("long").alias("cell")) for c in columns])
    )
    groups = F.explode(
        F.array(
            F.struct(F.lit(0).alias("level"), F.lit("").alias("name")),
            F.struct(F.lit(1).alias("level"), F.col("script").alias("name")),
            F.struct(F.lit(2).alias("level"), F.col("lang").alias("name")),
        )
    )
    # First per language, script and cell: a few thousand rows, whatever the corpus.
    counts = ok.select("script", "lang", cells.alias("c")).groupBy("script", "lang", "c").agg(F.count("*").alias("n"))
    counts = counts.select(groups.alias("g"), "c.measure", "c.cell", "n").select("g.level", "g.name", "measure", "cell", "n").where("name is not null")
    counts = counts.groupBy("level", "name", "measure", "cell").agg(F.sum("n").alias("n"))
    key = Window.partitionBy("level", "name", "measure")
    ranked = counts.withColumn("total", F.sum("n").over(key)).withColumn("upto", F.sum("n").over(key.orderBy("cell")))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("cell")))

    q = ranked.groupBy("level", "name", "measure").agg(
        F.max("total").alias("total"), quantile(0.25).alias("a"), quantile(0.5).alias("m"), quantile(0.75).alias("b")
    )
    q = q.where((F.col("level") == 0) | (F.col("total") >= min_group))

    def of(table: dict[str, float]) -> Column:
        return F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(table[c.split("_", 1)[1]]))])[F.col("measure")]

    def side(cells: Column) -> Column:
        return width * F.greatest(cells * of(STEP), of(LEAST))

    low = F.col("m") * of(STEP) - side(F.col("m") - F.col("a"))
    high = F.col("m") * of(STEP) + side(F.col("b") - F.col("m"))
    return q.select("level", "name", "measure", low.alias("low"), (F.col("m") * of(STEP)).alias("middle"), high.alias("high"))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)


def verdicts(
    spark: SparkSession,
    docs: DataFrame,
    vocabularies: tuple[str, ...] = VOCABULARIES,
    folder: str | None = None,
    width: float = WIDTH,
    min_group: int = MIN_GROUP,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str | None = "lang",
) -> DataFrame:
    """Measures of every row with ``base_failed`` and ``kept``.

    A row is kept if it passes the base rules and every measure lies in the band of its
    language, or of its script if the language has none (or is null), or of the corpus.
    Bands widen for short texts (``SHORT``). In an empty table
    there is nothing to judge; where no document passes the base rules there are no bands.
    """
    measured = stored(spark, measures(docs, vocabularies, folder, doc_id, text, lang), "fertility")
    columns = [c for c in measured.columns if re.match(r"m\d+_", c)]
    limits: dict[tuple[int, str], dict[str, tuple[float, float, float]]] = {}
    for r in bands(measured, width, min_group).collect():  # a language in it has min_group documents
        limits.setdefault((r["level"], r["name"]), {})[r["measure"]] = (r["low"], r["middle"], r["high"])

    def table(level: int) -> Column:
        rows = [x for (at, name), own in sorted(limits.items()) if at == level for x in (F.lit(name), F.array(*[F.lit(v) for c in columns for v in own[c]]))]
        return F.create_map(*rows) if rows else F.lit(None).cast("map<string, array<double>>")

    n = F.greatest(F.col("n_words"), F.lit(1))
    spread = 1 + SHORT[0] / F.sqrt(n) + SHORT[1] / n
    band = F.coalesce(F.try_element_at(table(2), F.coalesce("lang", F.lit(""))), F.try_element_at(table(1), F.col("script")), F.try_element_at(table(0), F.lit("")))
    inside = F.lit(True)
    for i, c in enumerate(columns):
        low, middle, high = (F.col("_band")[3 * i + k] for k in range(3))
        inside = inside & F.col(c).between(middle - (middle - low) * spread, middle + (high - middle) * spread)
    failed = _base_failed()
    judged = measured.withColumn("_band", band).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("_band")
