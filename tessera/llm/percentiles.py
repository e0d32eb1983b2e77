"""Mergeable percentile sketches: randomised compactor hierarchies."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import running_totals
from tessera.session import cut

#: Items of a level before it is compacted.
K = 512
#: Values a task holds before it sends the sketches it has.
HELD = 1_000_000
#: Seeds the random choices of all tasks, with what tells a task and its part from others.
SEED = 20

LEVELS = pa.list_(pa.list_(pa.float64()))
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "date": pa.date32()}
SKETCH = "n bigint, err2 double, levels array<array<double>>"


def generator(*parts: object) -> np.random.Generator:
    """Random choices that are the same when this task runs again, and independent of those of other tasks and other ``parts`` (a turn, a group, a chunk)."""
    task = TaskContext.get()
    return np.random.default_rng([SEED, task.partitionId() if task else 0, zlib.crc32(repr(parts).encode())])


class Compactors:
    """A hierarchy of buffers: an item of level h stands for 2**h values."""

    __slots__ = ("err2", "levels", "n")

    def __init__(self) -> None:
        self.n, self.err2, self.levels = 0, 0.0, [np.empty(0)]

    def add(self, values: np.ndarray, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.empty(0))
        self.levels[level] = np.concatenate([self.levels[level], values])

    def compact(self, rng: np.random.Generator, k: int = K) -> Compactors:
        """Sort every level that holds more than ``k`` items and pass alternate ones up, from a random first or second.

        With an odd number the largest item stays. Each pass moves any rank by at most 2**h either way, by
        chance and without bias, so err2 adds 4**h.
        """
        h = 0
        while h < len(self.levels):
            items = self.levels[h]
            if len(items) > k:
                items = np.sort(items)
                even = len(items) - len(items) % 2
                self.levels[h] = items[even:]
                self.add(items[int(rng.integers(2)) : even : 2], h + 1)
                self.err2 += 4.0**h
            h += 1
        return self


def sketch(values: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """A sketch of ``column`` per group of ``keys``: the keys, n, err2 (see :func:`rank_bound`) and levels.

    Tasks sketch what they read, so a hot group leaves each task as one small row; then the sketches of
    a group are merged (see :func:`merge`). A group of at most ``k`` values is kept whole, and its
    percentiles are exact. Nulls, NaN and infinities do not count; a group without values has no row.
    Null keys form a group.
    """
    types = [values.schema[c].dataType.simpleString() for c in keys]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(keys, types, strict=True)), SKETCH])
    arrow = pa.schema([*((c, ARROW[t]) for c, t in zip(keys, types, strict=True)), ("n", pa.int64()), ("err2", pa.float64()), ("levels", LEVELS)])
    finite = values.filter(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))).select(*keys, F.col(column).cast("double").alias(column))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        count = chunk = 0
        for batch in batches:
            held.append(batch.to_pandas())
            count += batch.num_rows
            if count >= HELD:
                yield from send(held, chunk)
                held, count, chunk = [], 0, chunk + 1
        yield from send(held, chunk)

    def send(held: list[pd.DataFrame], chunk: int) -> Iterator[pa.RecordBatch]:
        if not sum(map(len, held)):
            return
        data = pd.concat(held)
        codes = data.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(codes, kind="stable")
        codes, items, frame = codes[order], data[column].to_numpy()[order], data[keys].iloc[order]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        ends, rng = np.r_[starts[1:], len(codes)], generator("sketch", keys, chunk)
        heads = zip(*(frame[c].iloc[starts].astype(object).where(frame[c].iloc[starts].notna(), None) for c in keys), strict=True)
        done = []
        for key, a, b in zip(heads, starts, ends, strict=True):
            c = Compactors()
            c.add(items[a:b])
            c.n = int(b - a)
            done.append((key, c.compact(rng, k) if b - a > k else c))
        yield _batch(done, arrow)

    return merge(finite.mapInArrow(partial, schema), keys, k, combine=False)


def merge(sketches: DataFrame, keys: list[str], k: int = K, combine: bool = True) -> DataFrame:
    """Merge sketches level by level into one per group of ``keys`` (fewer keys: layers to stacks, days to months).

    A group's sketches are first merged where they lie (unless ``combine`` is false), so a hot group leaves
    each task as one sketch of at most ``k`` items a level; then those are shuffled and merged, one at a
    time. Sketches that fit together stay uncompacted.
    """
    types = {f.name: f.dataType.simpleString() for f in sketches.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), SKETCH])
    arrow = pa.schema([*((c, ARROW[types[c]]) for c in keys), ("n", pa.int64()), ("err2", pa.float64()), ("levels", LEVELS)])

    def run(batches: Iterator[pa.RecordBatch], turn: str) -> Iterator[pa.RecordBatch]:
        key, now, rng, out = None, None, None, []
        wide = len(keys)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(wide)]
            counts, errors = batch.column(wide).to_pylist(), batch.column(wide + 1).to_pylist()
            lists = batch.column(wide + 2)
            outer, inner, items = lists.offsets.to_numpy(), lists.values.offsets.to_numpy(), lists.values.values.to_numpy(zero_copy_only=False)
            for at, this in enumerate(zip(*columns, strict=True)):
                if now is None or this != key:
                    if now is not None:
                        out.append((key, now))
                    key, now, rng = this, Compactors(), generator(turn, keys, this, counts[at], errors[at])
                for h, level in enumerate(range(outer[at], outer[at + 1])):
                    if inner[level + 1] > inner[level]:
                        now.add(items[inner[level] : inner[level + 1]], h)
                now.n, now.err2 = now.n + counts[at], now.err2 + errors[at]
                if any(len(x) > k for x in now.levels):
                    now.compact(rng, k)
            if len(out) >= 2000:
                yield _batch(out, arrow)
                out = []
        if now is not None:
            out.append((key, now))
        if out:
            yield _batch(out, arrow)

    rows = sketches.select(*keys, "n", "err2", "levels")
    if combine:
        rows = rows.sortWithinPartitions(*keys).mapInArrow(lambda batches: run(batches, "combine"), schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: run(batches, "merge"), schema)


def _batch(done: list[tuple[tuple, Compactors]], arrow: pa.Schema) -> pa.RecordBatch:
    """Sketches as rows of keys, n, err2 and levels."""
    keys = list(zip(*(key for key, _ in done), strict=True))
    levels = [level for _, c in done for level in c.levels]
    items = np.concatenate(levels) if levels else np.empty(0)
    ends = lambda sizes: pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    nested = pa.ListArray.from_arrays(ends([len(c.levels) for _, c in done]), pa.ListArray.from_arrays(ends([len(x) for x in levels]), pa.array(items)))
    columns = [pa.array(key, field.type) for key, field in zip(keys, arrow, strict=False)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([c.n for _, c in done], pa.int64()), pa.array([c.err2 for _, c in done], pa.float64()), nested], schema=arrow)


def rank_bound(err2: float, failure: float = 1e-9) -> float:
    """No rank answered by a sketch is off by more, but with probability ``failure``.

    A compaction of level h shifts a rank by -2**h, 0 or 2**h with mean 0, independently, so by
    Hoeffding's inequality the sum exceeds t with probability at most 2 exp(-t**2 / (2 err2)).
    """
    return math.sqrt(2 * err2 * math.log(2 / failure))


def percentiles(sketches: DataFrame, keys: list[str], pcts: list[int], failure: float = 1e-9) -> DataFrame:
    """The percentiles of each sketch: the keys, n, pct, value, low, high, rank_error.

    The percentile is the value at position ceil(pct / 100 * n) in ascending order. ``low`` and ``high``
    enclose it but with probability ``failure``; where rank_error is 0 all three are equal and exact.
    """
    types = {f.name: f.dataType.simpleString() for f in sketches.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "n bigint, pct int, value double, low double, high double, rank_error double"])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                levels = [np.asarray(x, dtype=float) for x in row.levels]
                items = np.concatenate(levels)
                order = np.argsort(items, kind="stable")
                items, ranks = items[order], np.cumsum(np.concatenate([np.full(len(x), 1 << h) for h, x in enumerate(levels)])[order])
                off = rank_bound(row.err2, failure) if row.err2 else 0.0
                at = lambda r: items[min(int(np.searchsorted(ranks, r)), len(items) - 1)]  # noqa: B023, E731
                for pct in pcts:
                    want = -(-pct * row.n // 100)
                    low, high = want - off, want + off
                    rows.append((*row[: len(keys)], row.n, pct, at(want), -math.inf if off and low < 1 else at(max(1, low)), math.inf if off and high > row.n else at(high), off))
            yield pd.DataFrame(rows, columns=[*keys, "n", "pct", "value", "low", "high", "rank_error"])

    return sketches.select(*keys, "n", "err2", "levels").mapInPandas(answer, schema)


def exact_percentiles(values: DataFrame, keys: list[str], column: str, wanted: DataFrame) -> DataFrame:
    """Exact percentiles where a sketch left a bracket: ``wanted`` has the keys, n, pct, low, high.

    One pass counts what lies below each bracket and gathers the distinct values inside it, with counts
    combined before the shuffle; only a bracket's values, a small share of a group, are put in order.
    A bracket that misses its rank (see :func:`percentiles`) is opened to all values and taken again.
    """
    asked = cut(wanted.select(*keys, "n", "pct", "low", "high"), "wanted")
    found = cut(_inside(values, keys, column, asked), "exact")
    missed = asked.join(found, [*keys, "pct"], "left_anti").withColumn("low", F.lit(-math.inf)).withColumn("high", F.lit(math.inf))
    if missed.isEmpty():
        return found
    return found.unionByName(_inside(values, keys, column, missed))


def _inside(values: DataFrame, keys: list[str], column: str, asked: DataFrame) -> DataFrame:
    """The keys, pct and value of the percentiles that lie in their brackets."""
    joined = values.select(*keys, column).join(asked, keys).withColumn("_in", F.when(F.col(column) < F.col("low"), -1).when(F.col(column) <= F.col("high"), 0).otherwise(1)).filter("_in <= 0")
    counts = joined.groupBy(*keys, "n", "pct", "_in", F.when(F.col("_in") == 0, F.col(column)).alias("value")).agg(F.count("*").alias("_c"))
    ranked = running_totals(counts, [*keys, "pct"], ["_in", "value"], ["_c"]).withColumn("_rank", F.ceil(F.col("pct") * F.col("n") / 100))
    return ranked.filter((F.col("_in") == 0) & (F.col("_c_upto") >= F.col("_rank")) & (F.col("_c_upto") - F.col("_c") < F.col("_rank"))).select(*keys, "pct", "value")


def readings(cells: DataFrame) -> DataFrame:
    """cell_id, stack, layer, day, clonal_marker of each valid reading (finite, above 0, below 1), each cell_id once.

    Copies of a cell carry the same content; were they to differ, the least valid stack, layer, day and
    marker would count, each for itself. Nulls in stack or layer are kept as groups.
    """
    marker = F.col("clonal_marker")
    valid = cells.filter((marker > 0) & (marker < 1) & ~F.isnan(marker) & F.col("cell_id").isNotNull())
    once = valid.select("cell_id", "stack", "layer", F.to_date("measured_at").alias("day"), marker).groupBy("cell_id")
    return once.agg(*[F.min(c).alias(c) for c in ("stack", "layer", "day", "clonal_marker")])
