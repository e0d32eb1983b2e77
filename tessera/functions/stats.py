"""Percentiles and empirical distributions as expressions and small plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import running_totals


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, a column per share. Nulls do not count."""
    return rows.groupBy(*keys).agg(*[F.percentile(value, F.lit(s)).alias(name) for name, s in shares.items()])


def ecdf(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with the share of rows below each. Runs over distinct values, in chunks of their order; nulls do not count."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cum = running_totals(counts, keys, [value], ["_n"])
    return cum.select(*keys, value, ((F.col("_n_upto") - F.col("_n")) / F.col("_n_all")).alias("share_below"))


def epdf(rows: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Density in ``bins`` equal bins between the least and largest value of a group: bin (from 0), n, density. A constant group has one bin without density."""
    ranges = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_all"))
    width = F.nullif((F.col("_hi") - F.col("_lo")) / bins, F.lit(0.0))
    at = F.coalesce(F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)), F.lit(0))
    counts = rows.filter(F.col(value).isNotNull()).join(ranges, keys).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.max(F.col("_all") * width).alias("_w"))
    return counts.withColumn("density", F.col("n") / F.col("_w")).drop("_w")
