"""Row hashes that place a key in the cells of a sketch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.schema import column_names

# Prime modulus and one (multiplier, offset) pair per sketch row.
PRIME = 2147483647
MULTIPLIERS = (1103515245, 1812433253, 1566083941, 2034173521)
OFFSETS = (12345, 97531, 424243, 777767)
_NEXT = (69621, 48271)


def row_pair(i: int) -> tuple[int, int]:
    """Multiplier and offset of sketch row ``i``: the fixed pairs, then powers of them by a step."""
    turn, base = divmod(i, len(OFFSETS))
    a, b = (pow(step, turn, PRIME) for step in _NEXT)
    return MULTIPLIERS[base] * a % PRIME, OFFSETS[base] * b % PRIME


def with_row_hashes(df: DataFrame, keys: Sequence[str], d: int, prefix: str) -> DataFrame:
    """Add ``prefix0`` .. ``prefix{d-1}``: the row hashes of a composite key.

    One projection per key column: the squaring step would otherwise double the
    expression with every key, and the optimizer keeps such projections apart.
    """
    if d < 1:
        raise ValueError(f"a sketch has at least one row, not {d}")
    pairs = [row_pair(i) for i in range(d)]
    kept = [f"`{c}`" for c in df.columns]
    names = [f"{prefix}{i}" for i in range(d)]
    df = df.selectExpr(*kept, *[f"CAST({b} AS BIGINT) AS {n}" for n, (_, b) in zip(names, pairs)])
    for key in column_names(keys):
        mixed = [
            f"(({n} + `{key}`) % {PRIME} * {a} + {b}) % {PRIME} AS {n}"
            for n, (a, b) in zip(names, pairs)
        ]
        squared = [f"({n} * {n} + {a}) % {PRIME} AS {n}" for n, (a, _) in zip(names, pairs)]
        df = df.selectExpr(*kept, *mixed).selectExpr(*kept, *squared)
    return df


def with_cells(df: DataFrame, keys: Sequence[str], d: int, width: int, prefix: str = "cell") -> DataFrame:
    """Add ``cell0`` .. ``cell{d-1}``: one cell number per sketch row, below ``width``."""
    kept = [f"`{c}`" for c in df.columns]
    hashed = with_row_hashes(df, keys, d, prefix)
    return hashed.selectExpr(*kept, *[f"{prefix}{i} % {width} AS {prefix}{i}" for i in range(d)])


def cell_array(d: int, prefix: str = "cell") -> Column:
    """The cells of one key as an array of (row, cell) pairs, ready to explode."""
    return F.array(
        *[F.struct(F.lit(i).alias("row"), F.col(f"{prefix}{i}").alias("cell")) for i in range(d)]
    )


def explode_cells(df: DataFrame, keys: Sequence[str], d: int, width: int) -> DataFrame:
    """One row per (input row, sketch row), with columns ``row`` and ``cell``."""
    kept = df.columns
    return with_cells(df, keys, d, width, "_cell").select(*kept, F.inline(cell_array(d, "_cell")))
