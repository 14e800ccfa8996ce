"""Scalar column functions used by the packet operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from packetloom.schema import Operand, operand

COMPARISONS = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "bit_and": lambda a, b: a.bitwiseAND(b) != 0,
}


def compare(left: Operand, op: str, right: Operand) -> Column:
    """Six comparisons, and ``bit_and`` which is true when any common bit is set."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}; use one of {sorted(COMPARISONS)}")
    return COMPARISONS[op](operand(left), operand(right))


def branch(cases: Sequence[tuple[Column, Operand]], otherwise: Operand) -> Column:
    """if / elif / else: the value of the first true condition."""
    if not cases:
        return operand(otherwise)
    (cond, value), *rest = cases
    expr = F.when(cond, operand(value))
    for cond, value in rest:
        expr = expr.when(cond, operand(value))
    return expr.otherwise(operand(otherwise))


def floor_div(value: Operand, step: int) -> Column:
    """Whole steps in a long (exact below 2**53, monotone beyond)."""
    return F.floor(operand(value) / F.lit(step)).cast("long")


def add_mod32(value: Operand, n: int) -> Column:
    """Addition that wraps like an unsigned 32-bit word."""
    return F.pmod(operand(value).cast("long") + F.lit(n), F.lit(1 << 32))


def ipv4_text(addr: Operand) -> Column:
    """Dotted text of a host-order IPv4 address."""
    a = operand(addr)
    return F.concat_ws(".", *[F.shiftright(a, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def ipv4_number(text: Operand) -> Column:
    """Host-order IPv4 address of a dotted text."""
    parts = F.split(operand(text), r"\.")
    return sum(
        (F.get(parts, F.lit(i)).cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)),
        F.get(parts, F.lit(0)).cast("long") * (1 << 24),
    )


def nanoseconds(seconds: Operand) -> Column:
    return (operand(seconds) * F.lit(1e9)).cast("long")


def big_endian(data: Operand, offset: Column | int, n: int) -> Column:
    """Unsigned integer held in ``n`` bytes of a binary, from byte ``offset`` (0-based).

    Bytes beyond the end of the binary are left out; with none left the value is 0.
    """
    pos = (operand(offset) + 1).cast("int")
    piece = F.hex(F.substring(operand(data), pos, F.lit(n)))
    return F.coalesce(F.conv(piece, 16, 10).cast("long"), F.lit(0).cast("long"))


def ip_checksum(data: Operand, offset: Column | int, n_bytes: Column | int) -> Column:
    """16-bit ones-complement checksum of an IP header; 0 when the header is sound."""
    start, size = operand(offset).cast("int"), operand(n_bytes).cast("int")
    words = F.when(size >= 2, F.sequence(F.lit(0), (size / 2).cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    total = F.aggregate(
        words,
        F.lit(0).cast("long"),
        lambda acc, i: acc + big_endian(data, start + i * 2, 2),
    )
    total = total + F.when(size % 2 == 1, big_endian(data, start + size - 1, 1) * 256).otherwise(0)
    # An IP header has at most 30 words, so two folds bring the sum into 16 bits.
    for _ in range(2):
        total = total.bitwiseAND(0xFFFF) + F.shiftright(total, 16)
    return F.lit(0xFFFF).cast("long") - total
