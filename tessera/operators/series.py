"""Ordered series: frames, smoothing, resampling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _order(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running_mean(series: DataFrame, keys: list[str], order: list[str], value: str, window: int) -> DataFrame:
    """Mean of each row and the ``window`` - 1 rows before it in its series; series shorter than the window give nothing."""
    w = _order(keys, order)
    out = series.withColumn("position", F.row_number().over(w)).withColumn("running_mean", F.avg(value).over(w.rowsBetween(1 - window, 0)))
    return out.filter(F.col("position") >= window)


def rolling_windows(series: DataFrame, keys: list[str], order: list[str], value: str, window: int, resolution: int) -> DataFrame:
    """Mean and population deviation of windows of ``window`` rows that start every ``resolution`` rows.

    There are floor((n - window + 1) / resolution) of them, so a last full window may be left out.
    """
    w = _order(keys, order)
    ahead = w.rowsBetween(0, window - 1)
    at = series.withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    out = at.withColumn("window_mean", F.avg(value).over(ahead)).withColumn("window_std", F.stddev_pop(value).over(ahead))
    number = F.floor(F.col("_p") / resolution)
    kept = out.filter((F.col("_p") % resolution == 0) & (number < F.floor((F.col("_n") - window + 1) / resolution)))
    return kept.select(*keys, number.cast("int").alias("window_no"), F.col("_p").alias("start"), "window_mean", "window_std")


def binned_mean(series: DataFrame, keys: list[str], order: list[str], value: str, window: int) -> DataFrame:
    """Means of consecutive windows that do not overlap."""
    return rolling_windows(series, keys, order, value, window, window)


def savgol(series: DataFrame, keys: list[str], order: list[str], value: str, window: int = 100) -> DataFrame:
    """Add ``smoothed``: local straight-line fits over ``window`` rows (odd; an even window grows by one).

    In the middle of a series that is the centred mean; the first and last half windows take the line
    fitted to the first or last whole window. Series shorter than the window keep null.
    """
    window += 1 - window % 2
    half = window // 2
    w, whole = _order(keys, order), Window.partitionBy(*keys)
    at = series.withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole)).withColumn("_mean", F.avg(value).over(w.rowsBetween(-half, half)))
    x = F.col("_p").cast("double")
    first, last = F.col("_p") < window, F.col("_p") >= F.col("_n") - window
    fits = at.groupBy(*keys).agg(*[f(F.when(part, F.col(value)), F.when(part, x)).alias(name) for part, name, f in ((first, "_b0", F.regr_intercept), (first, "_m0", F.regr_slope), (last, "_b1", F.regr_intercept), (last, "_m1", F.regr_slope))])
    joined = at.join(fits, keys) if keys else at.crossJoin(F.broadcast(fits))
    smoothed = F.when(F.col("_p") < half, F.col("_b0") + F.col("_m0") * x).when(F.col("_p") >= F.col("_n") - half, F.col("_b1") + F.col("_m1") * x).otherwise(F.col("_mean"))
    return joined.withColumn("smoothed", F.when(F.col("_n") >= window, smoothed)).withColumnRenamed("_p", "position").drop("_n", "_mean", "_b0", "_m0", "_b1", "_m1")


def detrend(series: DataFrame, keys: list[str], order: list[str], value: str, window: int = 99) -> DataFrame:
    """Add ``trend`` (see :func:`savgol`) and ``residual``."""
    return savgol(series, keys, order, value, window).withColumnRenamed("smoothed", "trend").withColumn("residual", F.col(value) - F.col("trend"))


def smooth(series: DataFrame, keys: list[str], order: list[str], value: str, window: int) -> DataFrame:
    """Rolling means at a fifth of the window, then local lines over the same number of windows; null results where there are too few."""
    rolled = rolling_windows(series, keys, order, value, window, max(1, window // 5))
    return savgol(rolled, keys, ["window_no"], "window_mean", window)


def _windows(series: DataFrame, keys: list[str], order: list[str], value: str, window: int, resolution: int) -> DataFrame:
    """keys, window_no and the values of each window, gathered: a window is a bounded number of rows."""
    w = _order(keys, order)
    at = series.withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).withColumn("_values", F.collect_list(value).over(w.rowsBetween(0, window - 1)))
    number = F.floor(F.col("_p") / resolution)
    kept = at.filter((F.col("_p") % resolution == 0) & (number < F.floor((F.col("_n") - window + 1) / resolution)))
    return kept.select(*keys, number.cast("int").alias("window_no"), "_values")


def roll_apply(series: DataFrame, keys: list[str], order: list[str], value: str, window: int, resolution: int, func: Callable[[list[float]], float]) -> DataFrame:
    """``func`` of the values in each window of :func:`rolling_windows`: a window at a time, in Arrow batches."""

    @F.pandas_udf("double")
    def reduced(windows: pd.Series) -> pd.Series:
        return windows.map(lambda v: float(func(list(v))))

    return _windows(series, keys, order, value, window, resolution).select(*keys, "window_no", reduced("_values").alias("reduced"))


def subsample(rows: DataFrame, id_column: str, fraction: float, seed: int = 5) -> DataFrame:
    """About ``fraction`` of the rows, chosen by a hash of their id: the same rows whatever the partitioning. Null ids are one id."""
    return rows.filter(F.pmod(F.xxhash64(id_column, F.lit(seed)), F.lit(1 << 40)) < int(fraction * (1 << 40)))


#: Statistics that :func:`bootstrap` knows, from the sums of weights, of values and of their squares.
STATISTICS = {
    "mean": lambda w, s, q: s / F.nullif(w, F.lit(0)),
    "sum": lambda w, s, q: s,
    "std": lambda w, s, q: F.sqrt(F.greatest(q / F.nullif(w, F.lit(0)) - F.pow(s / F.nullif(w, F.lit(0)), F.lit(2.0)), F.lit(0.0))),
}


def bootstrap(rows: DataFrame, keys: list[str], value: str, id_column: str, statistic: str = "mean", rounds: int = 1000, confidence: float = 95.0, seed: int = 5) -> DataFrame:
    """Percentile interval of a statistic under resampling with replacement: keys, low, high, centre (its mean over the rounds).

    Each row enters each round a Poisson(1) number of times, drawn from a hash of its id and the round, so the result
    depends on the seed alone. Tasks draw for a block of rows and all rounds at once and emit one row of
    partial sums per group and round: nothing is multiplied before the shuffle, whatever the size of a
    group. ``statistic``: one of :data:`STATISTICS`, or a function of three columns (weights, weighted values,
    weighted squares). Nulls in ``value`` do not count; null keys are a group; rows of equal id are drawn together.
    """
    sums = [f"_{c}" for c in "wsq"]
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, round int, _w double, _s double, _q double"
    # P(count > k) of a Poisson variable of mean 1, for k from 0 on
    tails = 1 - np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                group = part.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(part), dtype=np.int64)
                first = np.unique(group, return_index=True)[1]
                x = part["_x"].to_numpy(dtype=float)
                z = part["_h"].to_numpy(dtype=np.int64).view(np.uint64)[None, :] + np.arange(1, rounds + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
                times = (u[..., None] < tails).sum(axis=-1).astype(float)
                sorted_by = np.argsort(group, kind="stable")
                starts = np.searchsorted(group[sorted_by], np.arange(len(first)))
                totals = [np.add.reduceat((times * f)[:, sorted_by], starts, axis=1) for f in (1.0, x, x * x)]
                heads = part[keys].iloc[first]
                out = pd.concat([heads] * rounds, ignore_index=True) if keys else pd.DataFrame(index=range(rounds))
                yield out.assign(round=np.repeat(np.arange(rounds, dtype=np.int32), len(first)), **{c: t.ravel() for c, t in zip(sums, totals, strict=True)})

    used = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"), F.xxhash64(id_column, F.lit(seed)).alias("_h"))
    partial = used.mapInPandas(drawn, schema.lstrip(", "))
    of = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    per_round = partial.groupBy(*keys, "round").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("_v", of(*map(F.col, sums)))
    tail = (100 - confidence) / 200
    return per_round.groupBy(*keys).agg(F.percentile("_v", F.lit(tail)).alias("low"), F.percentile("_v", F.lit(1 - tail)).alias("high"), F.avg("_v").alias("centre"))


def rolling_interval(series: DataFrame, keys: list[str], order: list[str], value: str, window: int, resolution: int, func: Callable[[np.ndarray], float] = np.mean, rounds: int = 200, confidence: float = 95.0, seed: int = 5) -> DataFrame:
    """Percentile interval of ``func`` under resampling of each window of :func:`rolling_windows`: low, high. A window at a time, in Arrow batches."""
    tail = (100 - confidence) / 2

    def interval(values: list[float]) -> list[float]:
        known = np.array([v for v in values if v is not None], dtype=float)
        rng = np.random.default_rng(seed)
        found = [float(func(known[rng.integers(0, len(known), len(known))])) for _ in range(rounds)] if len(known) else [math.nan]
        return np.percentile(found, [tail, 100 - tail]).tolist()

    @F.pandas_udf("array<double>")
    def reduced(windows: pd.Series) -> pd.Series:
        return windows.map(interval)

    kept = _windows(series, keys, order, value, window, resolution)
    return kept.withColumn("_i", reduced("_values")).select(*keys, "window_no", F.get("_i", F.lit(0)).alias("low"), F.get("_i", F.lit(1)).alias("high"))
