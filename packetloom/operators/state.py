"""Per-key registers: stateless branches, running registers and general folds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from packetloom.functions.scalar import branch, floor_div
from packetloom.operators.folds import KEY_NULLS, Fold, GroupedFold, KeyedFold, without_nulls
from packetloom.operators.running import (
    NO_SEGMENT,
    SEGMENT_ROWS,
    max_before,
    running,
    running_last,
    running_max,
    running_sum,
    split_hot,
)
from packetloom.schema import EPOCH, ORDER, Operand, column_names, operand
from packetloom.sources.shared import ensure_checkpoint_dir, remove_folder, shared_dir

FOLD_ROWS = 1 << 20


def map_udf(df: DataFrame, assignments: Mapping[str, Sequence[tuple[Column, Operand]] | Column]) -> DataFrame:
    """Assign variables by branches, all from the values before the call.

    A variable that no branch assigns keeps its earlier value, or is 0 when new.
    """
    new = {}
    for name, cases in assignments.items():
        if isinstance(cases, Column):
            new[name] = cases
        else:
            new[name] = branch(cases, F.col(name) if name in df.columns else F.lit(0))
    return df.withColumns(new)


def state_add(
    df: DataFrame,
    keys: Sequence[str],
    delta: Column,
    out: str,
    by: str = EPOCH,
    order: str = ORDER,
    segment: str | None = None,
    rows: int | None = SEGMENT_ROWS,
    exchange: bool = True,
) -> DataFrame:
    """Register changed by ``+= delta``; ``out`` is its value after the packet."""
    ks = [by, *column_names(keys)]
    df = running(df, ks, {"_reg": running_sum(delta)}, order, segment, rows, exchange=exchange)
    return df.withColumn(out, F.coalesce(F.col("_reg"), F.lit(0)).cast("long")).drop("_reg")


def state_last(
    df: DataFrame,
    keys: Sequence[str],
    cond: Column,
    value: Operand,
    out: str,
    by: str = EPOCH,
    order: str = ORDER,
    segment: str | None = None,
    rows: int | None = SEGMENT_ROWS,
    exchange: bool = True,
) -> DataFrame:
    """Register assigned ``value`` where ``cond`` holds; ``out`` is the last one, 0 if none."""
    ks = [by, *column_names(keys)]
    scan = running_last(F.when(cond, operand(value)), order)
    df = running(df, ks, {"_reg": scan}, order, segment, rows, exchange=exchange)
    return df.withColumn(out, F.coalesce(F.col("_reg"), F.lit(0))).drop("_reg")


def state_max_seen(
    df: DataFrame,
    keys: Sequence[str],
    value: Operand,
    out: str,
    by: str = EPOCH,
    order: str = ORDER,
    segment: str | None = None,
    rows: int | None = SEGMENT_ROWS,
    exchange: bool = True,
) -> DataFrame:
    """Register raised to the largest value; ``out`` is what it held before the packet."""
    ks = [by, *column_names(keys)]
    df = running(df, ks, {"_reg": max_before(operand(value))}, order, segment, rows, exchange=exchange)
    return df.withColumn(out, F.coalesce(F.col("_reg"), F.lit(0))).drop("_reg")


def state_branches(
    df: DataFrame,
    keys: Sequence[str],
    cases: Sequence[tuple[Column, str, Operand]],
    out: str,
    by: str = EPOCH,
    order: str = ORDER,
    rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """Register under branches: the first (condition, ``=`` or ``+=`` or ``max=``, value) that holds
    assigns, adds to or raises it; ``out`` is its value after the packet, from 0 on.

    Each packet maps the register r to the greater of r + a and b: an assignment has no a, an
    addition no b, and such maps compose to one of their kind. With the sums S of all a and
    the assignments counted so far, the register is S plus the greatest b - S since the last
    assignment, which are running values; so a hot key is cut into segments like any other.
    """

    def pick(of: Callable[[str, Operand], Column]) -> Column:
        chosen = None
        for cond, op, value in cases:
            if op not in ("=", "+=", "max="):
                raise ValueError("a branch assigns with =, += or max=")
            chosen = F.when(cond, of(op, value)) if chosen is None else chosen.when(cond, of(op, value))
        return chosen

    nothing = F.lit(None).cast("long")
    added = F.coalesce(pick(lambda op, v: operand(v).cast("long") if op == "+=" else F.lit(0).cast("long")), F.lit(0))
    assigned = F.coalesce(pick(lambda op, v: F.lit(int(op == "="))), F.lit(0))
    least = pick(lambda op, v: nothing if op == "+=" else operand(v).cast("long"))

    ks = [by, *column_names(keys)]
    kept = [c for c in df.columns if c != out]
    cut = "_cut" if rows is not None else None
    df = df.withColumns({"_least": least})
    df = split_hot(df, ks, rows, order, cut) if cut else df
    df = running(df, ks, {"_sum": running_sum(added), "_era": running_sum(assigned)}, order, cut, rows)
    level = F.when(F.col("_least").isNotNull(), F.struct(F.col("_era").alias("era"), (F.col("_least") - F.col("_sum")).alias("level")))
    df = running(df, ks, {"_top": running_max(level)}, order, cut, rows, exchange=False)
    # Eras only grow, so the greatest (era, level) is the greatest level of the present era.
    start = F.when(F.col("_era") == 0, F.greatest(F.col("_top.level"), F.lit(0))).otherwise(F.col("_top.level"))
    return df.select(*kept, (F.col("_sum") + start).cast("long").alias(out))


def _padded(table: pa.Table, prefix: str, is_state: bool, schema: pa.Schema) -> pa.Table:
    """The table under prefixed names, with nulls for the columns of the other kind."""
    n = table.num_rows
    columns = {prefix + name: table.column(name) for name in table.column_names}
    columns["is_state"] = pa.array([is_state] * n, pa.bool_())
    arrays = [columns.get(f.name, pa.nulls(n, f.type)) for f in schema]
    return pa.Table.from_arrays(arrays, schema=schema)


def stateful_fold(
    df: DataFrame,
    keys: Sequence[str],
    fn: Fold,
    initial: tuple,
    state_schema: T.StructType,
    out_schema: T.StructType,
    by: str = EPOCH,
    order: str = ORDER,
    rows: int = FOLD_ROWS,
    on_close: Callable[[tuple, tuple], pd.DataFrame] | None = None,
    wave_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Run any register function over the ordered packets of each epoch and key.

    ``fn`` may be called several times per group, with the state it returned last, so its
    outputs must not depend on where the calls part; what is said once per group belongs
    into ``on_close``, which gets the last state and replaces the outputs of ``fn``.
    No call sees more than ``rows`` packets of a group: the calls for one follow each other
    in its task. A ``GroupedFold`` is called for many groups at once. Groups beyond
    ``wave_rows`` packets (and ``rows``) are too large for a task: such a group is cut by its
    own packets in order, and its pieces run one after the other with the state carried in a
    checkpointed table. Pieces of the same rank run together for all groups. This costs a few
    actions when such groups exist; their number follows ``wave_rows``, not ``rows``.
    """
    spark = df.sparkSession
    group = [by, *column_names(keys)]
    wave_rows = max(rows, wave_rows)
    cut = split_hot(df, group, wave_rows, order, "_segment")
    inputs = df.columns

    def in_calls(key, packets, state):
        """Outputs of the packets of a group in order, and its state after them."""
        made = []
        for at in range(0, len(packets), rows):
            out, state = fn(key, packets.iloc[at : at + rows].reset_index(drop=True), state)
            made.append(out)
        return made[0] if len(made) == 1 else pd.concat(made, ignore_index=True), state

    def whole(key, packets):
        out, state = in_calls(key, packets.sort_values(order, ignore_index=True), initial)
        return out if on_close is None else on_close(key, state)

    # A stated number of partitions: by size alone they would be merged, but the
    # work here is Python per group.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordinary = cut.where(F.col("_segment") == NO_SEGMENT).select(*inputs)
    if isinstance(fn, GroupedFold):
        keyed = KeyedFold(fn, on_close, group, df.schema, initial, rows)
        placed = without_nulls(ordinary, group, order).repartition(tasks, KEY_NULLS, *group)
        ordinary = placed.sortWithinPartitions(KEY_NULLS, *group, order).mapInPandas(keyed.over_sorted, out_schema)
    else:
        ordinary = ordinary.repartition(tasks, *group).groupBy(*group).applyInPandas(whole, out_schema)

    folder = shared_dir(spark, "fold")
    hot = cut.where(F.col("_segment") != NO_SEGMENT).select(*inputs)
    hot.write.parquet(f"{folder}/hot")
    hot = spark.read.schema(hot.schema).parquet(f"{folder}/hot")
    waves = _write_waves(hot, group, order, wave_rows, f"{folder}/waves")
    if not waves:
        remove_folder(spark, folder)
        return ordinary
    packets = spark.read.parquet(f"{folder}/waves")
    ensure_checkpoint_dir(spark)
    state_type = T.StructType([*[df.schema[g] for g in group], *state_schema.fields])
    # One table of two kinds of rows: outputs, and the registers after the piece.
    both = T.StructType(
        [
            *[T.StructField(f"out_{f.name}", f.dataType) for f in out_schema.fields],
            *[T.StructField(f"reg_{f.name}", f.dataType) for f in state_type.fields],
            T.StructField("is_state", T.BooleanType()),
        ]
    )
    out_arrow, state_arrow, both_arrow = (to_arrow_schema(t) for t in (out_schema, state_type, both))

    def piece(key, rows_now, state):
        key = tuple(k.as_py() for k in key)
        before = initial
        if state.num_rows:
            before = tuple(state.column(f.name)[0].as_py() for f in state_schema.fields)
        made, after = [], before
        if rows_now.num_rows:
            out, after = in_calls(key, rows_now.to_pandas().sort_values(order, ignore_index=True), before)
            if on_close is None:
                made.append(_padded(pa.Table.from_pandas(out, out_arrow, preserve_index=False), "out_", False, both_arrow))
        registers = dict(zip(state_arrow.names, [*key, *after]))
        made.append(_padded(pa.Table.from_pylist([registers], state_arrow), "reg_", True, both_arrow))
        return pa.concat_tables(made)

    state = spark.createDataFrame([], state_type)
    done = [ordinary]
    for wave in range(waves):
        now = packets.where(F.col("_wave") == wave).select(*inputs)
        step = now.groupBy(*group).cogroup(state.groupBy(*group)).applyInArrow(piece, both).checkpoint()
        outputs = step.where(~F.col("is_state"))
        done.append(outputs.select(*[F.col(f"out_{n}").alias(n) for n in out_schema.names]))
        registers = step.where(F.col("is_state"))
        state = registers.select(*[F.col(f"reg_{n}").alias(n) for n in state_type.names])
    remove_folder(spark, folder)
    if on_close is not None:

        def close(key, registers):
            return on_close(key, tuple(registers[f.name].iloc[0] for f in state_schema.fields))

        done = [ordinary, state.groupBy(*group).applyInPandas(close, out_schema)]
    return reduce(DataFrame.unionByName, done)


def _write_waves(hot: DataFrame, group: Sequence[str], order: str, rows: int, path: str) -> int:
    """Write the packets of the large groups by wave; the number of waves.

    A group is counted in short runs of packet numbers, and neighbouring runs are packed
    into one wave as long as they hold at most ``rows`` packets: the number of waves
    follows the size of the largest group, not the span of its packet numbers.
    """
    step = max(1, rows // 8)
    runs = hot.withColumn("_run", floor_div(order, step))
    before = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy(*group, "_run").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(before), F.lit(0))
    waves = sizes.select(*group, "_run", F.floor(earlier / max(1, rows - step)).alias("_wave"))
    runs.join(waves, [*group, "_run"]).drop("_run").write.partitionBy("_wave").parquet(path)
    last = waves.agg(F.max("_wave")).first()[0]
    return 0 if last is None else last + 1
