"""Fill-in-the-middle: texts cut in three at unit ends and put together in another order.

A batch of texts goes through whole-array steps of ``pyarrow.compute``: units split into
lists, flattened with the indices of their texts, numbered within each text, filtered by
role, made lists again and joined to pieces. No step looks at one text alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import slices

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
"""White space and the word after it, or white space that ends the text. All of it is
ASCII, so bytes and code points are cut alike."""

CUT = b"\xff"
"""Set before each unit; a byte that no UTF-8 text has."""

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 50, 80


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four numbers below 2^32 from the seed and the id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]


def pieces(text: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Units of each text (binary, no nulls), and its prefix, middle and suffix: up to the
    smaller of ``first % (units + 1)`` and ``second % (units + 1)``, up to the larger, the rest."""
    units = pc.split_pattern(pc.replace_substring_regex(text, UNIT, CUT + rb"\0"), CUT)
    sizes = pc.list_value_length(units)
    n = sizes.to_numpy(zero_copy_only=False).astype(np.int64) - 1  # nothing stands before the first cut
    a, b = first % (n + 1), second % (n + 1)
    ends = [np.minimum(a, b), np.maximum(a, b), n]
    parent = pc.list_parent_indices(units)
    flat = pc.list_flatten(units)
    starts = pa.array(np.cumsum(n + 1) - n)  # where each text's first unit stands
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(starts, parent))
    out, low = [], np.zeros(len(n), np.int64)
    for high in ends:
        own = pc.and_(pc.greater_equal(ordinal, pc.take(pa.array(low), parent)), pc.less(ordinal, pc.take(pa.array(high), parent)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(high - low)]), pa.int32())  # a text of 2 GB has no more units
        out.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, own)), pa.scalar(b"", pa.large_binary())))
        low = high
    return n, out


def joined(*parts: pa.Array | bytes) -> pa.Array:
    """Parts of each row, one after the other."""
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.large_binary()) if isinstance(p, bytes) else p for p in parts], pa.scalar(b"", pa.large_binary()))


def chosen(form: pa.Array, psm: pa.Array, spm: pa.Array, plain: pa.Array) -> pa.Array:
    return pc.if_else(pc.equal(form, "psm"), psm, pc.if_else(pc.equal(form, "spm"), spm, plain))


def restore(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts again, from nothing but outputs and forms: texts in another form than plain
    hold no mark of their own, so the first of each kind is the one that was set."""

    def of(kind: str, marks: list[bytes], order: tuple[int, int, int]) -> pa.Array:
        # Other rows get marks without texts, so that every row splits.
        rest, found = pc.if_else(pc.equal(form, kind), output, pa.scalar(b"".join(marks), pa.large_binary())), []
        for mark in marks:
            both = pc.split_pattern(rest, mark, max_splits=1)
            found.append(pc.list_element(both, 0))
            rest = pc.list_element(both, 1)
        found = [*found[1:], rest]  # behind the first, second and third mark
        return joined(*[found[k] for k in order])

    return chosen(form, of("psm", [PREFIX, SUFFIX, MIDDLE], (0, 2, 1)), of("spm", [SUFFIX, PREFIX, MIDDLE], (1, 2, 0)), output)


def transform(text: pa.Array, h: list[np.ndarray], check: bool) -> list[pa.Array]:
    """Columns of ``fill_in_middle`` after the id."""
    body = pc.fill_null(text.cast(pa.large_binary()), b"")
    n, (prefix, middle, suffix) = pieces(body, h[0], h[1])
    marked = pc.match_substring(body, PREFIX)
    for mark in (SUFFIX, MIDDLE):
        marked = pc.or_(marked, pc.match_substring(body, mark))
    plain = pc.or_(marked, pa.array((n == 0) | (h[2] % 100 >= PLAIN_FROM)))
    form = pc.if_else(plain, "plain", pc.if_else(pa.array(h[3] % 100 < SPM_BELOW), "spm", "psm"))
    output = chosen(form, joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), body)
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(p.cast(pa.large_string())).cast(pa.int64())) for p in (prefix, middle)]
    out = [pa.array(n), form.cast(pa.string()), *chars, output.cast(pa.large_string())]
    return [*out, restore(output, form).cast(pa.large_string())] if check else out


def fill_in_middle(docs: DataFrame, seed: int = 42, check: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` counts units (``UNIT``) of the whole text; null counts as empty. Two numbers drawn
    from ``seed`` and the id end the prefix and the middle, a third leaves ``PLAIN_FROM`` %
    of the texts changed, a fourth makes ``SPM_BELOW`` % of these ``spm`` (suffix first), the
    others ``psm``. Empty texts and texts that hold a mark stay ``plain``, with null for the
    code points of prefix and middle. With ``check``, ``restored`` has the text rebuilt from
    output and form. Rows do not depend on each other: repeated ones get equal results.
    Memory follows the longest text, some ten times its bytes.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h = [batch.column(f"_h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *transform(batch.column("text"), h, check)], names=names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] + ["restored"] * check
    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *draws(seed, F.col(doc_id)))
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string" + ", restored string" * check
    return narrow.mapInArrow(work, schema)
