"""Evaluating and choosing sketch sizes.

A configuration gives rows and pages for each table of a sketched query. Many
configurations are evaluated in one job. Filters are built once at their finest
width and folded down to the others; tables that configurations have in common
are counted once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.hashing import with_row_hashes
from packetloom.operators.accuracy import AccuracySpec, confidence_gate, precision_recall, relative_error
from packetloom.operators.distinct import distinct_first, first_rows
from packetloom.operators.epochs import complete_epochs, enough_epochs, n_complete
from packetloom.operators.running import SEGMENT_ROWS, running, running_sum
from packetloom.operators.sketch import PAGE_BYTES, cells_per_row, non_negative
from packetloom.plans import detections
from packetloom.schema import EPOCH, ORDER, column_names
from packetloom.sources.shared import ensure_checkpoint_dir

# Memory layout of the target the sizes are chosen for.
ALU_PER_STAGE = 4
PAGE_PER_STAGE = 48
MAX_PAGE_FOR_ONE_ALU = 32
BLOOM_BITS = 1
COUNTER_BITS = 32

VALUE = "value"

# One (rows, pages) pair per sketch table of the query, in pipeline order.
Config = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Limits:
    """What a configuration may use, and how its cost is weighed."""

    alu_max: int = 4
    page_max: int = 32
    max_stage_per_op: int = 1
    alpha: float = 0.4
    beta: float = 0.6


@dataclass(frozen=True)
class CountQuery:
    """[prepare ->] [distinct ->] sum per ``key`` -> at least ``n`` -> keys and their values.

    ``key`` is a column or several. What is summed is the non-negative column ``value``,
    or 1 per packet. With ``distinct`` the tables are a Bloom filter and a Count-Min,
    else one Count-Min. ``prepare`` holds any steps before, in columns the sizes do not
    change.
    """

    key: str | tuple[str, ...]
    n: int
    distinct: tuple[str, ...] = ()
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    value: str | None = None

    @property
    def keys(self) -> list[str]:
        return column_names([self.key] if isinstance(self.key, str) else self.key)

    @property
    def step(self) -> Column:
        return non_negative(F.col(self.value)) if self.value else F.lit(1)

    @property
    def tables(self) -> tuple[str, ...]:
        return ("distinct", "count") if self.distinct else ("count",)

    @property
    def bits(self) -> tuple[int, ...]:
        return (BLOOM_BITS, COUNTER_BITS) if self.distinct else (COUNTER_BITS,)

    def first_packets(self, packets: DataFrame, n_epoch: int) -> DataFrame:
        """The packets of the first epochs that can change a table.

        A repeat of a distinct key finds all its bits set whatever the sizes, so
        only the first packet of each key matters and all configurations share
        this exact pass.
        """
        own = dict.fromkeys([*column_names(self.distinct), *self.keys, *([self.value] if self.value else [])])
        kept = self.prepare(complete_epochs(packets, n_epoch)).select(EPOCH, ORDER, *own)
        return distinct_first(kept, self.distinct) if self.distinct else kept

    def exact(self, first: DataFrame) -> DataFrame:
        """(epoch, key, value) reported without sketches, from the first packets."""
        sums = first.groupBy(EPOCH, *self.keys).agg(F.sum(self.step).alias(VALUE))
        return sums.where(F.col(VALUE) >= self.n)

    def reports(
        self, first: DataFrame, configs: Sequence[Config], page_bytes: int, rows: int | None
    ) -> DataFrame:
        return sketch_reports(first, self, configs, page_bytes, rows)


@dataclass(frozen=True)
class SynFloodQuery:
    """Servers with over ``n`` half-open handshakes, from two registers in shared cells."""

    n: int = 12
    key: str = "nkey"
    tables: tuple[str, ...] = ("nextseq", "cnt")

    @property
    def keys(self) -> list[str]:
        return [self.key]

    def first_packets(self, packets: DataFrame, n_epoch: int) -> DataFrame:
        return detections.handshake_packets(complete_epochs(packets, n_epoch))

    def exact(self, first: DataFrame) -> DataFrame:
        return detections.flooded_servers(first, self.n)

    def reports(
        self, first: DataFrame, configs: Sequence[Config], page_bytes: int, rows: int | None
    ) -> DataFrame:
        sizes = [tuple((d, cells_per_row(w, COUNTER_BITS, page_bytes)) for d, w in config) for config in configs]
        return detections.flooded_servers_sizes(first, sizes, self.n, rows)


SketchedQuery = CountQuery | SynFloodQuery


def finest(widths: Sequence[int]) -> dict[int, list[int]]:
    """Widths by the largest given one that they divide: its cells, modulo theirs, are their cells."""
    out: dict[int, list[int]] = {}
    for width in sorted(set(widths), reverse=True):
        base = next((b for b in out if b % width == 0), width)
        out.setdefault(base, []).append(width)
    return out


def _structs(*rows: dict[str, int | Column]) -> Column:
    return F.array(*[F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in r.items()]) for r in rows])


def first_touches(first: DataFrame, elements: Sequence[str], sizes: Sequence[tuple[int, int]], kept: Sequence[str]) -> DataFrame:
    """The packet that sets each bit of Bloom filters of many ``sizes`` (rows, cells): ``row, width,
    epoch, cell``, its number and ``kept``.

    A packet is spread to the rows of the finest width only. Narrower tables fold out of that
    one: the first to touch a cell is the first of those that touched the cells folded into it.
    """
    d_max = max(d for d, _ in sizes)
    hashed = with_row_hashes(first, sorted(column_names(elements)), d_max, "_h")
    bases = finest([w for _, w in sizes])
    cells = _structs(*[{"row": i, "base": b, "cell": F.col(f"_h{i}") % b} for b in bases for i in range(d_max)])
    touched = hashed.select(EPOCH, ORDER, *kept, F.inline(cells))
    fine = first_rows(touched, [EPOCH, "row", "base", "cell"], ORDER)
    narrower = [F.when(F.col("base") == b, F.array(*[F.lit(w) for w in ws])) for b, ws in bases.items()]
    folds = fine.select(EPOCH, ORDER, *kept, "row", "cell", F.explode(F.coalesce(*narrower)).alias("width"))
    folds = folds.withColumn("cell", F.col("cell") % F.col("width"))
    return first_rows(folds, [EPOCH, "row", "width", "cell"], ORDER)


def sketch_reports(
    first: DataFrame,
    query: CountQuery,
    configs: Sequence[Config],
    page_bytes: int = PAGE_BYTES,
    rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """(conf_id, epoch, key, value) reported under each configuration, from the query's first
    packets; the value is the estimate at the key's last packet.

    Filters of one size are one filter, whatever counters follow, and counters of one width
    behind it are one table, of which a configuration takes its first rows. An estimate at
    the last packet of a key is no sum of wider tables' cells at their ends, so counters are
    not folded.
    """
    keys = query.keys
    step = [query.value] if query.value else []
    kept = list(dict.fromkeys([*keys, *step]))
    sized = [
        tuple((d, cells_per_row(w, bits, page_bytes)) for (d, w), bits in zip(c, query.bits)) for c in configs
    ]
    filters = list(dict.fromkeys(c[:-1] for c in sized))  # what precedes the counters; one empty entry without a filter
    if query.distinct:
        sizes = [f[0] for f in filters]
        set_by = first_touches(first, query.distinct, sizes, kept)
        passing = {}
        for i, (d, width) in enumerate(sizes):
            passing.setdefault(width, []).append((i, d))
        users = F.coalesce(
            *[F.when(F.col("width") == w, _structs(*[{"filter": i, "d": d} for i, d in us])) for w, us in passing.items()]
        )
        counted = set_by.select(EPOCH, ORDER, *kept, "row", F.inline(users)).where(F.col("row") < F.col("d"))
        counted = counted.select("filter", EPOCH, ORDER, *kept).distinct()
    else:
        counted = first.select(F.lit(0).alias("filter"), EPOCH, ORDER, *kept)

    deepest: dict[tuple[int, int], int] = {}
    for c in sized:
        at = (filters.index(c[:-1]), c[-1][1])
        deepest[at] = max(deepest.get(at, 0), c[-1][0])
    hashed = with_row_hashes(counted, keys, max(deepest.values()), "_h")
    tables = [
        F.when(
            F.col("filter") == f,
            _structs(*[{"row": i, "width": w, "cell": F.col(f"_h{i}") % w} for (g, w), d in deepest.items() if g == f for i in range(d)]),
        )
        for f in range(len(filters))
    ]
    at = hashed.select("filter", EPOCH, ORDER, *kept, F.inline(F.coalesce(*tables)))
    summed = running(
        at, ["filter", "width", EPOCH, "row", "cell"], {"_est": running_sum(query.step)}, ORDER, rows=rows
    )
    # Cells only grow: the largest sum at a key's packets is that at its last one, and the
    # least over its rows is its estimate.
    most = summed.groupBy("filter", "width", EPOCH, *keys, "row").agg(F.max("_est").alias("_most"))
    takers: dict[tuple[int, int], list[dict[str, int]]] = {}
    for i, c in enumerate(sized):
        takers.setdefault((filters.index(c[:-1]), c[-1][1]), []).append({"conf_id": i, "d": c[-1][0]})
    taken = [F.when((F.col("filter") == f) & (F.col("width") == w), _structs(*own)) for (f, w), own in takers.items()]
    each = most.select(EPOCH, *keys, "row", "_most", F.inline(F.coalesce(*taken))).where(F.col("row") < F.col("d"))
    reached = each.groupBy("conf_id", EPOCH, *keys).agg(F.min("_most").alias(VALUE))
    return reached.where(F.col(VALUE) >= query.n)


def config_table(spark, configs: Sequence[Config], query: SketchedQuery) -> DataFrame:
    """(conf_id, table, d, w), one row per table of each configuration."""
    rows = [
        (i, name, d, w) for i, config in enumerate(configs) for name, (d, w) in zip(query.tables, config)
    ]
    return spark.createDataFrame(rows, "conf_id int, table string, d int, w int")


def resource_score(conf_df: DataFrame, limits: Limits = Limits(), by: Sequence[str] = ("conf_id",)) -> DataFrame:
    """Cost of each configuration of a (conf_id, table, d, w) frame: rows, memory and widest use."""
    n = F.count(F.lit(1))
    stages = limits.max_stage_per_op
    alus = F.sum("d")
    pages = F.sum(F.col("d") * F.col("w")) + alus
    score = (
        F.lit(limits.alpha) * alus / (n * ALU_PER_STAGE * stages)
        + F.lit(limits.beta / 2) * pages / (n * PAGE_PER_STAGE * stages)
        + F.lit(limits.beta / 2) * F.avg("w") / MAX_PAGE_FOR_ONE_ALU
    )
    return conf_df.groupBy(*by).agg(score.alias("score"))


def valid_table(limits: Limits = Limits()) -> Column:
    """Whether a table of ``d`` rows and ``w`` pages fits the limits."""
    d, w, stages = F.col("d"), F.col("w"), limits.max_stage_per_op
    return (
        d.between(1, min(ALU_PER_STAGE * stages, limits.alu_max))
        & w.between(1, PAGE_PER_STAGE)
        & (F.ceil(d / stages) * (w + 1) <= PAGE_PER_STAGE)
    )


def valid_conf(conf_df: DataFrame, limits: Limits = Limits(), by: Sequence[str] = ("conf_id",)) -> DataFrame:
    """Configurations whose tables all fit the limits."""
    fits = conf_df.groupBy(*by).agg(F.bool_and(valid_table(limits)).alias("_ok"))
    return fits.where("_ok").select(*by)


def _judge(
    first: DataFrame,
    query: SketchedQuery,
    configs: Sequence[Config],
    spec: AccuracySpec,
    n_epoch: int,
    limits: Limits,
    page_bytes: int,
    rows: int | None,
    enough: Column,
) -> DataFrame:
    ids = range(len(configs))
    if spec.are_max is not None and not isinstance(query, CountQuery):
        raise ValueError("only a query that reports values has a relative error")
    est = query.reports(first, configs, page_bytes, rows)
    exact = query.exact(first).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("conf_id"), "*")
    metrics = precision_recall(est, exact, query.keys, n_epoch, ids)
    if spec.are_max is not None:
        metrics = metrics.join(relative_error(est, exact, query.keys, VALUE, n_epoch, ids), ["conf_id", EPOCH])
    # A trace that is too short would leave epochs without packets, which count as perfect.
    gated = confidence_gate(metrics, spec, n_epoch, ["conf_id"]).where(enough)
    return gated.join(resource_score(config_table(first.sparkSession, configs, query), limits), "conf_id")


def evaluate_configs(
    packets: DataFrame,
    query: SketchedQuery,
    configs: Sequence[Config],
    spec: AccuracySpec,
    n_epoch: int | None = None,
    limits: Limits = Limits(),
    page_bytes: int = PAGE_BYTES,
    rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """Success, precision, recall (and relative error) and cost of every configuration, in one job.

    The first ``n_epoch`` epochs count, all complete ones if no number is given; a trace
    without so many complete ones fails.
    """
    n_epoch = n_complete(packets) if n_epoch is None else n_epoch
    first = query.first_packets(packets, n_epoch)
    return _judge(first, query, configs, spec, n_epoch, limits, page_bytes, rows, enough_epochs(packets, n_epoch))


def accuracy_report(
    packets: DataFrame,
    query: SketchedQuery,
    config: Config,
    spec: AccuracySpec,
    n_epoch: int | None = None,
    page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """One row: does the configuration meet the intent on this trace (search or held-out)?"""
    result = evaluate_configs(packets, query, [config], spec, n_epoch, page_bytes=page_bytes)
    return result.drop("conf_id", "score")


def _fits(pair: tuple[int, int], limits: Limits) -> bool:
    d, w = pair
    stages = limits.max_stage_per_op
    return (
        0 < d <= min(ALU_PER_STAGE * stages, limits.alu_max)
        and 0 < w <= PAGE_PER_STAGE
        and -(-d // stages) * (w + 1) <= PAGE_PER_STAGE
    )


def cost(config: Config, limits: Limits) -> float:
    """What ``resource_score`` gives for one configuration."""
    n, stages = len(config), limits.max_stage_per_op
    alus, pages, widest = sum(d for d, _ in config), sum(d * w for d, w in config), sum(w for _, w in config) / n
    part = limits.alpha * alus / (n * ALU_PER_STAGE * stages)
    return part + limits.beta / 2 * (pages + alus) / (n * PAGE_PER_STAGE * stages) + limits.beta / 2 * widest / MAX_PAGE_FOR_ONE_ALU


def all_configs(n_tables: int, limits: Limits) -> list[Config]:
    """Every configuration within the limits, pages doubling, cheapest first."""
    pages = [1 << i for i in range(limits.page_max.bit_length())]
    pairs = [p for p in product(range(1, limits.alu_max + 1), pages) if _fits(p, limits)]
    return sorted(product(pairs, repeat=n_tables), key=lambda c: (round(cost(c, limits), 12), c))


PROBES = 256
"""Configurations compared for one place in a wave."""


class Staircase:
    """What is still open among configurations in the order of their costs.

    One that passes closes all that cost no less; one that fails closes all that are no
    larger in any table. What passed last is the answer when nothing is open: the steps
    between the failed and the passed sizes have met.
    """

    def __init__(self, configs: Sequence[Config]):
        self.sizes = np.array(configs).reshape(len(configs), -1)
        self.open = np.ones(len(configs), bool)
        self.best: int | None = None

    def under(self, i: int, others: np.ndarray) -> np.ndarray:
        return (self.sizes[others] <= self.sizes[i]).all(axis=1)

    def settle(self, i: int, passed: bool) -> None:
        if passed:
            self.open[i:] = False
            self.best = i if self.best is None else min(i, self.best)
        else:
            self.open &= ~self.under(i, np.arange(len(self.open)))
            self.open[i] = False

    def wave(self, most: int) -> list[int]:
        """Up to ``most`` open ones, each chosen so that either verdict closes many of what the
        ones chosen before may leave open."""
        pools, out = [p for p in [np.flatnonzero(self.open)] if len(p)], []
        while pools and len(out) < most:
            pools.sort(key=len)
            pool = pools.pop()
            probes = pool[np.unique(np.linspace(0, len(pool) - 1, PROBES).astype(int))]
            closed = [min(int((pool >= i).sum()), int(self.under(i, pool).sum())) for i in probes]
            pick = int(probes[int(np.argmax(closed))])
            out.append(pick)
            left = pool[~self.under(pick, pool)]
            pools += [p for p in (left[left < pick], left[left > pick]) if len(p)]
        return sorted(out)

    def largest(self, among: Sequence[int]) -> list[int]:
        """Those that no other configuration reaches in every row and page count."""
        return [i for i in among if (self.sizes >= self.sizes[i]).all(axis=1).sum() == 1]


def tune_sketch(
    packets: DataFrame,
    query: SketchedQuery,
    spec: AccuracySpec,
    n_epoch: int | None = None,
    limits: Limits = Limits(),
    page_bytes: int = PAGE_BYTES,
    wave_size: int = 16,
) -> DataFrame:
    """The cheapest configuration that meets the intent: (conf_id, table, d, w, score, success).

    Candidates go through in waves, each one job; the packets they all start from are
    computed once and checkpointed. A size no larger than a failing one is taken to fail,
    and no size is judged that cannot be cheaper than one that passed; the search ends when
    none is left. Only the verdicts come to the driver. Where nothing passes, ``success`` is
    false and the size is the best of the largest ones: that with the greatest lesser one of
    precision and recall, then the cheapest. ``n_epoch`` is the number of epochs that count,
    all complete ones if none is given.
    """
    spark = packets.sparkSession
    ensure_checkpoint_dir(spark)
    n_epoch = n_complete(packets) if n_epoch is None else n_epoch
    enough = enough_epochs(packets, n_epoch)
    first = query.first_packets(packets, n_epoch).checkpoint()
    configs = all_configs(len(query.tables), limits)
    steps = Staircase(configs)
    reached: dict[int, float] = {}
    while wave := steps.wave(wave_size):
        judged = _judge(first, query, [configs[i] for i in wave], spec, n_epoch, limits, page_bytes, SEGMENT_ROWS, enough)
        for conf_id, success, precision, recall in judged.select("conf_id", "success", "precision", "recall").collect():
            reached[wave[conf_id]] = min(precision, recall)
            steps.settle(wave[conf_id], success)
    found = steps.best is not None
    best = steps.best if found else min(steps.largest(list(reached)), key=lambda i: (-reached[i], i))
    table = config_table(spark, [configs[best]], query)
    return table.withColumn("score", F.lit(cost(configs[best], limits))).withColumn("success", F.lit(found))


def verify_held_out(
    search: DataFrame,
    held_out: DataFrame,
    query: SketchedQuery,
    spec: AccuracySpec,
    n_epoch: int | None = None,
    n_held_out: int | None = None,
    limits: Limits = Limits(),
    page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """Sizes tuned on one trace, reported on another: the report's one row, the sizes in ``config``
    and whether they met the intent where they were tuned, in ``tuned``."""
    best = tune_sketch(search, query, spec, n_epoch, limits, page_bytes).collect()  # one row per table
    sizes = {r["table"]: (r["d"], r["w"]) for r in best}
    config = tuple(sizes[t] for t in query.tables)
    text = ",".join(f"{t}:{d}x{w}" for t, (d, w) in zip(query.tables, config))
    report = accuracy_report(held_out, query, config, spec, n_held_out, page_bytes)
    return report.select("*", F.lit(text).alias("config"), F.lit(best[0]["success"]).alias("tuned"))
