"""Comparison of populations and scoring of labels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.measure import LAYER
from tessera.operators.ordering import running_totals


def population_pairs(rows: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Moments and pairs: one row per pair of labels a < b of a group, with n, mean and sample variance of each."""
    m = rows.filter(F.col(label).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    side = lambda s: m.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("n", "mean", "var")], F.col(label).alias(s))
    on = [*keys] or None
    pairs = side("a").join(side("b"), on) if on else side("a").crossJoin(side("b"))
    return pairs.filter(F.col("a") < F.col("b"))


def t_statistics(pairs: DataFrame) -> DataFrame:
    """Add t with pooled variance, its degrees of freedom, and whether a's mean is greater."""
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.nullif(F.col("n_a") + F.col("n_b") - 2, F.lit(0))
    t = (F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b"))), F.lit(0.0))
    return pairs.withColumn("t", t).withColumn("df", F.col("n_a") + F.col("n_b") - 2).withColumn("a_greater", F.col("mean_a") > F.col("mean_b"))


def _value_counts(rows: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Distinct values with their count per label, combined before the shuffle."""
    return rows.filter(F.col(label).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, label, value).agg(F.count("*").alias("c"))


def _two(rows: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """For each pair of labels a < b: distinct values of both with their counts."""
    counts = _value_counts(rows, keys, label, value)
    labels = counts.select(*keys, F.col(label).alias("_l")).distinct()
    other = counts.join(labels, keys) if keys else counts.crossJoin(F.broadcast(labels))
    pair = other.filter(F.col("_l") != F.col(label)).select(*keys, F.least("_l", label).alias("a"), F.greatest("_l", label).alias("b"), value, F.when(F.col(label) < F.col("_l"), F.col("c")).otherwise(0).alias("ca"), F.when(F.col(label) > F.col("_l"), F.col("c")).otherwise(0).alias("cb"))
    return pair.groupBy(*keys, "a", "b", value).agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))


def ks_statistics(rows: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Largest gap between the empirical distributions of each pair of labels, with both sizes.

    Runs over distinct values, in chunks of their order.
    """
    pair = [*keys, "a", "b"]
    cum = running_totals(_two(rows, keys, label, value), pair, [value], ["ca", "cb"])
    return cum.groupBy(*pair).agg(F.max(F.abs(F.col("ca_upto") / F.col("ca_all") - F.col("cb_upto") / F.col("cb_all"))).alias("ks"), F.max("ca_all").alias("n_a"), F.max("cb_all").alias("n_b"))


def mann_whitney(rows: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """U of the first label of each pair, by midranks, with the tie term of its variance."""
    pair = [*keys, "a", "b"]
    both = _two(rows, keys, label, value).withColumn("t", F.col("ca") + F.col("cb"))
    ranked = running_totals(both, pair, [value], ["t"]).withColumn("_mid", F.col("t_upto") - (F.col("t") - 1) / 2)
    sums = ranked.groupBy(*pair).agg(F.sum(F.col("_mid") * F.col("ca")).alias("_r"), F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"))
    return sums.withColumn("u", F.col("_r") - F.col("n_a") * (F.col("n_a") + 1) / 2).drop("_r")


def mann_whitney_p(u: float, n_a: int, n_b: int, ties: float) -> float:
    """Two-sided p of U by the normal approximation with ties and continuity correction."""
    n = n_a + n_b
    var = n_a * n_b / 12 * ((n + 1) - ties / (n * (n - 1))) if n > 1 else 0.0
    return 1.0 if var <= 0 else math.erfc(max(0.0, abs(u - n_a * n_b / 2) - 0.5) / math.sqrt(2 * var))


def ks_p(ks: float, n_a: int, n_b: int) -> float:
    """Two-sided p of the Kolmogorov-Smirnov statistic by its limiting distribution."""
    z = ks * math.sqrt(n_a * n_b / (n_a + n_b))
    return 1.0 if z < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))


def t_p(t: float, df: int) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = (b, a, 1 - x) if flip else (a, b, x)
    front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(max(y, 1e-300)) + q * math.log(max(1 - y, 1e-300))) / p
    c, d, tiny = 1.0, 1 - (p + q) * y / (p + 1), 1e-300
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 300):
        for term in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * f if flip else front * f


#: Codes of the tests that :func:`compare` knows.
TESTS = ("ks", "t", "mw")


def compare(rows: DataFrame, keys: list[str], label: str, value: str, test: str = "ks") -> DataFrame:
    """Compare every pair of labels a < b: a, b, p, a_greater (by the mean), as one plan for all pairs."""
    test = test.lower()
    if test not in TESTS:
        raise ValueError(f"test must be one of {', '.join(TESTS)}")
    pairs = t_statistics(population_pairs(rows, keys, label, value))
    if test == "t":
        return pairs.withColumn("p", F.udf(lambda t, df: None if t is None or df < 1 else t_p(t, df), "double")("t", "df")).select(*keys, "a", "b", "p", "a_greater")
    p = F.udf(ks_p, "double")("ks", "n_a", "n_b") if test == "ks" else F.udf(mann_whitney_p, "double")("u", "n_a", "n_b", "ties")
    stats = (ks_statistics if test == "ks" else mann_whitney)(rows, keys, label, value).withColumn("p", p)
    return stats.select(*keys, "a", "b", "p").join(pairs.select(*keys, "a", "b", "a_greater"), [*keys, "a", "b"])


def concurrent_only(cells: DataFrame, label: str, a: object, b: object) -> DataFrame:
    """Cells of labels ``a`` and ``b`` near both: rows whose concurrent_{a} and concurrent_{b} (see regions.concurrency) hold."""
    return cells.filter(F.col(f"concurrent_{a}") & F.col(f"concurrent_{b}") & F.col(label).isin(a, b))


def concurrent_comparisons(cells: DataFrame, keys: list[str], label: str, values: list, value: str) -> DataFrame:
    """t statistics of each pair of labels, over the cells that are near both labels of the pair."""
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    parts = [t_statistics(population_pairs(concurrent_only(cells, label, a, b), keys, label, value)) for a, b in pairs]
    return reduce(DataFrame.unionByName, parts)


def sweep(rows: DataFrame, params: DataFrame, by: list[str], value: str, measured: str) -> DataFrame:
    """Score threshold labels for every replicate (``by``) and every row of a parameter table in one plan.

    ``params``: param_id, low, high; a small table, broadcast up to a million rows and an error beyond. The label of
    a value is how many of the two thresholds it reaches. Returns by, param_id, n, error, percent_correct, MAE, failed;
    a combination without a row that counts is listed with failed true and nulls.
    """
    if params.limit(1_000_001).count() > 1_000_000:
        raise ValueError("a sweep takes at most a million parameters")
    small = F.broadcast(params)
    label = (F.col(value) >= F.col("low")).cast("int") + (F.col(value) >= F.col("high")).cast("int")
    labelled = rows.select(*by, F.col(value), F.col(measured).alias("measured")).crossJoin(small).withColumn("predicted", label)
    grid = rows.select(*by).distinct().crossJoin(small.select("param_id"))
    return grid.join(score(labelled, [*by, "param_id"]), [*by, "param_id"], "left").withColumn("failed", F.col("n").isNull())


def scored(measured: Column, predicted: Column) -> dict[str, Column]:
    return {"difference": F.abs(measured - predicted), "correct": measured == predicted}


def score(labels: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, error (half the mean difference), percent_correct and MAE (half the mean over classes of their mean difference).

    Rows where measured or predicted is null do not count. ``by``: also per layer or replicate.
    """
    rows = labels.filter("measured is not null and predicted is not null").withColumns(scored(F.col("measured"), F.col("predicted")))
    classes = rows.groupBy(*by, "measured").agg(F.count("*").alias("n"), F.sum("difference").alias("d"), F.sum(F.col("correct").cast("int")).alias("c"))
    return classes.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("d") / (2 * F.sum("n"))).alias("error"), (F.sum("c") / F.sum("n")).alias("percent_correct"), (F.avg(F.col("d") / F.col("n")) / 2).alias("MAE"))


def confusion(labels: DataFrame) -> DataFrame:
    """Counts of measured and predicted labels with the rate within measured."""
    counts = labels.filter("measured is not null and predicted is not null").groupBy("measured", "predicted").agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("measured")))


def weighted_f1(labels: DataFrame) -> DataFrame:
    """F1 of each class weighted by its measured rows; a class never hit counts 0."""
    counts = confusion(labels)
    hit = F.sum(F.when(F.col("measured") == F.col("predicted"), F.col("n")).otherwise(0))
    real = counts.groupBy(F.col("measured").alias("k")).agg(F.sum("n").alias("r"), hit.alias("h"))
    said = counts.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("s"))
    f1 = 2 * F.col("h") / (F.col("r") + F.coalesce("s", F.lit(0)))
    return real.join(said, "k", "left").agg((F.sum(f1 * F.col("r")) / F.sum("r")).alias("f1"))


def per_layer(labels: DataFrame) -> DataFrame:
    return score(labels, LAYER)


def growth_trend(rows: DataFrame, column: str, replicate: str, value: str) -> DataFrame:
    """Mean, sample deviation and standard error (over the number of replicates, the largest id plus 1) per column; infinities do not count."""
    finite = F.when(F.abs(F.col(value)) < float("inf"), F.col(value))
    count = rows.agg((F.max(replicate) + 1).alias("_r"))
    stats = rows.groupBy(column).agg(F.avg(finite).alias("mean"), F.stddev_samp(finite).alias("std"))
    return stats.crossJoin(F.broadcast(count)).withColumn("sem", F.col("std") / F.sqrt("_r")).drop("_r")


def sweep_matrix(rows: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Mean per row and column id as a matrix, a column per id of ``columns``."""
    return rows.groupBy(row).pivot(column, columns).agg(F.avg(value))


def log2_fold(rows: DataFrame, keys: list[str], of: str, over: str) -> DataFrame:
    """log2 of the ratio of two mean results per key; null where a mean is not positive."""
    means = rows.groupBy(*keys).agg(F.avg(of).alias("_a"), F.avg(over).alias("_b"))
    return means.select(*keys, F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.log2(F.col("_a") / F.col("_b"))).alias("log2_fold"))
