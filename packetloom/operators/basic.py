"""Filters, projections, tagging and ordering of packets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.scalar import compare
from packetloom.schema import EPOCH, ORDER, Operand, column_names, operand

# Columns that say where in the stream a row belongs; a projection keeps them.
STREAM_POSITION = (EPOCH, "window", ORDER)


def filter_cmp(df: DataFrame, left: Operand, op: str, right: Operand) -> DataFrame:
    """Keep the packets for which ``left op right`` holds."""
    return df.where(compare(left, op, right))


def map_cols(
    df: DataFrame, map_keys: Sequence[str], new_import: Mapping[str, int | Mapping] | None = None
) -> DataFrame:
    """Project to ``map_keys`` and the stream position, with new columns.

    ``new_import`` gives an integer constant, or ``{"op": "diff", "values": [a, b]}``
    for ``a - b`` after a zip.
    """
    new: dict[str, Column] = {}
    for name, value in (new_import or {}).items():
        if isinstance(value, Mapping):
            if value.get("op") != "diff" or len(value.get("values", ())) != 2:
                raise ValueError(f"column {name!r}: only a diff of two columns can be imported")
            a, b = value["values"]
            new[name] = operand(a) - operand(b)
        elif isinstance(value, int) and not isinstance(value, bool):
            new[name] = F.lit(value)
        else:
            raise ValueError(f"column {name!r}: the imported value must be an integer")
    position = [c for c in STREAM_POSITION if c in df.columns]
    listed = [c for c in column_names(map_keys) if c not in position and c not in new]
    return df.select(*position, *listed, *[v.alias(k) for k, v in new.items()])


MASK_BITS = 62


def tag_queries(df: DataFrame, predicates: Mapping[str, Column], mask: str = "query_mask") -> DataFrame:
    """Serve many queries with one scan: bit i of ``mask`` is set for the i-th query.

    Beyond ``MASK_BITS`` queries there are more masks, named ``mask`` and a number. Packets
    that no query wants are dropped.
    """
    if not predicates:
        raise ValueError("no queries to tag")
    wanted = list(predicates.values())
    masks = {}
    for i in range(0, len(wanted), MASK_BITS):
        bits = [F.when(p, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, p in enumerate(wanted[i : i + MASK_BITS])]
        masks[_mask(mask, i)] = sum(bits[1:], bits[0])
    return df.withColumns(masks).where(reduce(lambda a, b: a | b, [F.col(m) != 0 for m in masks]))


def _mask(mask: str, index: int) -> str:
    return mask if index < MASK_BITS else f"{mask}{index // MASK_BITS}"


def tagged(df: DataFrame, index: int, mask: str = "query_mask") -> DataFrame:
    """The packets of the ``index``-th query of :func:`tag_queries`."""
    return df.where(F.col(_mask(mask, index)).bitwiseAND(F.lit(1 << index % MASK_BITS).cast("long")) != 0)


def by_query(df: DataFrame, predicates: Mapping[str, Column], name: str = "query") -> DataFrame:
    """One row per (packet, matching query), for queries that share their later steps."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(q)) for q, p in predicates.items()]))
    return df.select("*", F.explode(names).alias(name))


def order_packets(df: DataFrame) -> DataFrame:
    """Largest packets first, ties by addresses, ports and protocol, all descending.

    Packets alike in all of these follow packet order, which also lets a crowd of
    them be split over several sort ranges.
    """
    fields = [F.desc(c) for c in ("size", "src_addr", "dst_addr", "sport", "dport", "proto")]
    return df.orderBy(*fields, *[F.asc(ORDER) for _ in range(ORDER in df.columns)])


def report(df: DataFrame, keys: Sequence[str], by: str = EPOCH) -> DataFrame:
    """The set of result keys of each epoch."""
    return df.select(by, *column_names(keys)).distinct()
