"""Token counts of whole texts, huge ones in overlapping chunks that are spliced again.

Byte-level vocabularies cut a text into pieces from left to right and merge inside pieces
only, so a piece boundary that two encodings share makes all later boundaries shared. A
chunk starts anywhere; its pieces are right from the first boundary it has in common with
the chunk before, whose pieces are right by induction (except near its own end, where the
text it does not see could matter). The splice takes that boundary. Where the overlap has
none, the text is taken again with longer chunks and wider overlaps.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import slices, stored

CHUNK = 1 << 15
"""Characters of a chunk; longer texts are huge."""

OVERLAP = 256
CACHE = 400_000
"""Parts and pieces whose number of tokens a Python worker remembers."""

REMEMBERED = 64
"""Characters of the longest of them."""

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯΆΈ-ΊΌΎ-ΡΣ-ϵЀ-ҁҊ-ԧא-תء-غف-يぁ-ゖァ-ヺ一-龥가-힣"
MARKS = "!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷‐-‧"
SPACES = r" \t-\r\xa0\u3000"
PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
"""The rule of byte-level vocabularies, for characters whose kind is beyond doubt."""


def load(path: str):
    """A tokenizer that neither truncates nor pads."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def margin(tokenizer) -> int:
    """Characters before a chunk's end whose pieces may depend on what follows: the longest
    added token, and one."""
    return 2 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)


def boundaries(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of a text and the tokens before each, with the end of the text last."""
    e = tokenizer.encode(text, add_special_tokens=False)
    if not len(e):
        return np.array([0]), np.array([0])
    words = np.array([-1 if w is None else w for w in e.word_ids])
    starts = np.array([a for a, _ in e.offsets])
    special = np.array(e.special_tokens_mask, bool) | (words < 0)
    first = np.concatenate(([True], (words[1:] != words[:-1]) | special[1:] | special[:-1]))
    at = np.flatnonzero(first)
    return np.append(starts[at], len(text)), np.append(at, len(e))


def report(tokenizer, text: str, start: int, last: bool, overlap: int, counter: Counter | None = None) -> dict:
    """What splicing needs of a chunk: its boundaries near either end, with the tokens before them.

    With a ``counter``, where spaces begin pieces near both ends that have neighbours, those
    are the boundaries, and the parts between them are counted as in ordinary texts. Other
    chunks are encoded whole.
    """
    end = start + len(text)
    edge = margin(tokenizer)
    for find in ([counter.boundaries] if counter else []) + [lambda text: boundaries(tokenizer, text)]:
        pos, n = find(text)
        pos = pos + start
        # A chunk's own start is no boundary that it found, except at the start of the text.
        head = (pos > start) & (pos <= start + overlap) & (pos < end)
        tail = (pos > start) & (pos >= end - overlap) & (pos <= end - edge)
        if (start == 0 or head.any()) and (last or tail.any()):
            break
    return {
        "start": start,
        "last": last,
        "n": int(n[-1]),
        "head": pos[head].tolist(),
        "head_n": n[head].tolist(),
        "tail": pos[tail].tolist(),
        "tail_n": n[tail].tolist(),
    }


def splice(reports: list[dict]) -> int | None:
    """Tokens of a text from the reports of its chunks in order; None if two have no common boundary."""
    total, cut, before = 0, -1, 0  # tokens of the present chunk before the cut
    for own, following in zip(reports, reports[1:], strict=False):
        sure = {p: n for p, n in zip(own["tail"], own["tail_n"], strict=True) if p > max(cut, following["start"])}
        found = next(((p, n) for p, n in zip(following["head"], following["head_n"], strict=True) if p in sure), None)
        if found is None:
            return None
        total += sure[found[0]] - before
        cut, before = found
    return total + reports[-1]["n"] - before


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of overlapping chunks."""
    step = max(1, chunk - overlap)
    return [(at, text[at : at + chunk]) for at in range(0, max(1, len(text) - overlap), step)]


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


class Counter:
    """Tokens of ordinary texts: every different piece is encoded once.

    Texts of common characters are cut by the byte-level rule itself, and the library's
    merges are asked for pieces not seen before. Of other texts, and for vocabularies of
    another rule, parts go through the whole library: a space before a character that is
    neither space nor end always begins a piece, so a text may be cut there.
    """

    def __init__(self, tokenizer):
        from tokenizers import models, pre_tokenizers

        self.tokenizer = tokenizer
        rule, self.model = tokenizer.pre_tokenizer, tokenizer.model
        self.usual = isinstance(rule, pre_tokenizers.ByteLevel) and rule.use_regex and not rule.add_prefix_space
        self.usual = self.usual and tokenizer.normalizer is None and isinstance(self.model, models.BPE)
        added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.merged, self.known = Known(self.merge), Known(self.count)

    def pieces(self, text: str) -> list[str] | None:
        """Pieces of a text; None where the rule here is not sure to be the vocabulary's."""
        if not self.usual or self.added.search(text):
            return None
        own = PIECE.findall(text)
        return own if sum(map(len, own)) == len(text) else None

    def parts(self, text: str) -> list[str]:
        own = text.split(" ")
        if "" not in own and not any(p[:1].isspace() for p in own):
            return [own[0], *(" " + p for p in own[1:])]
        out = [own[0]]
        for p in own[1:]:
            if p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def cut(self, text: str) -> tuple[list[str], Iterator[int]]:
        """Pieces or parts of a text, and the tokens of each."""
        own = self.pieces(text)
        if own is not None:
            return own, map(self.merged.__getitem__, own)
        own = self.parts(text)
        return own, map(self.known.__getitem__, own)

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces or parts of a text and the tokens before each, with the end of the text last."""
        own, counts = self.cut(text)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        tokens = np.fromiter(counts, np.int64, len(own))
        return np.concatenate(([0], np.cumsum(sizes))), np.concatenate(([0], np.cumsum(tokens)))

    def __call__(self, texts: list[str]) -> list[int]:
        return [sum(self.cut(t)[1]) for t in texts]

    def count(self, part: str) -> int:
        own = self.pieces(part)
        if own is not None:
            return sum(map(self.merged.__getitem__, own))
        return len(self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0])

    def merge(self, piece: str) -> int:
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_LETTERS)))


class Known(dict):
    """Tokens of short strings, counted when first asked for; forgotten when there are too many."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, part: str) -> int:
        n = self.count(part)
        if len(part) <= REMEMBERED:
            if len(self) >= CACHE:
                self.clear()
            self[part] = n
        return n


def _tokenizer(path: str | None):
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return load(path or public_tokenizers.path("byte_bpe_50k.json"))


def count_huge(spark: SparkSession, huge: DataFrame, path: str | None, chunk: int, overlap: int) -> DataFrame:
    """``_row, n_tokens`` for stored rows ``_row, text``: chunks are dealt to all tasks, so one
    giant text is the work of many. Texts of which two chunks don't align are done again with
    chunks and overlaps four times as long."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = cut(text, chunk, overlap)
                for i in range(0, len(own), 64):
                    part = own[i : i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(part)), pa.array([a for a, _ in part]), pa.array([a == own[-1][0] for a, _ in part]), pa.array([t for _, t in part])],
                        names=["_row", "start", "last", "text"],
                    )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        counter = Counter(tokenizer)
        for batch in slices(batches):
            rows = [
                {"_row": row} | report(tokenizer, text, start, last, overlap, counter)
                for row, start, last, text in zip(*(batch.column(c).to_pylist() for c in ("_row", "start", "last", "text")), strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, kinds)

    def join(table: pa.Table) -> pa.Table:
        own = table.sort_by("start").to_pylist()
        return pa.table({"_row": pa.array([own[0]["_row"]], pa.int64()), "n_tokens": pa.array([splice(own)], pa.int64())})

    longs = pa.list_(pa.int64())
    kinds = pa.schema([("_row", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()), *((c, longs) for c in ("head", "head_n", "tail", "tail_n"))])
    reported = "_row long, start long, last boolean, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>"
    dealt = huge.mapInArrow(pieces, "_row long, start long, last boolean, text string").repartition("_row", "start")
    found = stored(spark, dealt.mapInArrow(encode, reported).groupBy("_row").applyInArrow(join, "_row long, n_tokens long"), "tokens")
    missed = found.where("n_tokens is null")
    if missed.isEmpty():
        return found
    again = huge.join(missed.select("_row"), "_row", "left_semi")
    return found.where("n_tokens is not null").unionByName(count_huge(spark, again, path, chunk * 4, overlap * 4))


def count_tokens(
    spark: SparkSession, docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row: UTF-8 bytes and tokens of the whole text.

    ``path``: a tokenizers file with a byte-level vocabulary, on every executor
    (byte_bpe_50k.json by default). Strings of special tokens inside texts count as the
    library counts them. Null and empty texts have 0 tokens. Texts of over ``chunk`` code
    points are huge: they are stored, cut and spliced; the others are read once.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(_tokenizer(path))
        for batch in slices(batches):
            counts = counter([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), size.alias("n_bytes"))
    is_huge = F.coalesce(F.length("text") > chunk, F.lit(False))
    counted = narrow.where(~is_huge).mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long")
    huge = stored(spark, narrow.where(is_huge).withColumn("_row", F.monotonically_increasing_id()), "huge")
    spliced = huge.drop("text").join(count_huge(spark, huge.select("_row", "text"), path, chunk, overlap), "_row")
    return counted.unionByName(spliced.select("doc_id", "n_bytes", "n_tokens"))
