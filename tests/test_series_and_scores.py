import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import compare, regions, series


def line(spark, n):
    return spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("o"), (2.0 * F.col("id") + 1).alias("v"))


def test_rolling_windows_by_hand(spark):
    rows = series.rolling_windows(line(spark, 10), ["k"], ["o"], "v", 4, 2).orderBy("window_no").collect()
    assert [r.start for r in rows] == [0, 2, 4] and rows[0].window_mean == 4.0
    assert series.binned_mean(line(spark, 8), ["k"], ["o"], "v", 4).count() == 1
    assert series.running_mean(line(spark, 3), ["k"], ["o"], "v", 4).count() == 0
    assert [r.reduced for r in series.roll_apply(line(spark, 10), ["k"], ["o"], "v", 4, 2, max).orderBy("window_no").collect()] == [7.0, 11.0, 15.0]


def test_local_lines_keep_a_line(spark):
    rows = series.detrend(line(spark, 50), ["k"], ["o"], "v", 10).collect()
    assert max(abs(r.residual) for r in rows) < 1e-9
    assert series.savgol(line(spark, 5), ["k"], ["o"], "v", 10).filter("smoothed is not null").count() == 0
    assert series.smooth(line(spark, 200), ["k"], ["o"], "v", 10).count() > 0


def test_bootstrap_interval_holds_the_mean(spark):
    df = line(spark, 500)
    r = series.bootstrap(df, ["k"], "v", "o", rounds=300).first()
    middle = df.agg(F.avg("v"), F.stddev_pop("v")).first()
    error = middle[1] / math.sqrt(500)
    assert r.low < middle[0] < r.high and r.high - r.low == pytest.approx(2 * 1.96 * error, rel=0.2) and r.centre == pytest.approx(middle[0], abs=error / 3)
    again = series.bootstrap(df.repartition(7), ["k"], "v", "o", rounds=300).first()
    assert (again.low, again.high) == (pytest.approx(r.low), pytest.approx(r.high))
    whole = series.bootstrap(df, [], "v", "o", statistic=lambda w, s, q: s / w, rounds=50).first()
    assert whole.low < middle[0] < whole.high
    std = series.bootstrap(df, ["k"], "v", "o", "std", rounds=200).first()
    assert std.low < middle[1] < std.high
    assert series.bootstrap(df.limit(0), ["k"], "v", "o", rounds=5).count() == 0


def test_rolling_interval_and_subsample(spark):
    df = line(spark, 40)
    rows = series.rolling_interval(df, ["k"], ["o"], "v", 10, 5, np.median).collect()
    plain = {r.window_no: r.reduced for r in series.roll_apply(df, ["k"], ["o"], "v", 10, 5, np.median).collect()}
    assert {r.window_no for r in rows} == set(plain) and all(r.low <= plain[r.window_no] <= r.high for r in rows)
    some = {r.o for r in series.subsample(spark.range(10_000).withColumnRenamed("id", "o"), "o", 0.2).collect()}
    assert 1800 < len(some) < 2200 and some == {r.o for r in series.subsample(spark.range(10_000).withColumnRenamed("id", "o").repartition(3), "o", 0.2).collect()}


def test_sweep_lists_combinations_without_rows(spark):
    rows = spark.createDataFrame([("a", 0.2, 0), ("a", 0.9, 2), ("b", None, 1), ("c", 0.5, None)], "k string, v double, g int")
    params = spark.createDataFrame([(0, 0.3, 0.6), (1, 0.95, 0.99)], "param_id int, low double, high double")
    got = {(r.k, r.param_id): (r.n, r.percent_correct, r.failed) for r in compare.sweep(rows, params, ["k"], "v", "g").collect()}
    assert got == {("a", 0): (2, 1.0, False), ("a", 1): (2, 0.5, False), **{(k, p): (None, None, True) for k in "bc" for p in (0, 1)}}


def population(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 7.0], [2.0, 3.0, 8.0, 9.0]
    return a, b, spark.createDataFrame([("p", 0, v) for v in a] + [("p", 1, v) for v in b] + [("p", None, 3.0), ("p", 1, None)], "k string, g int, v double")


def test_statistics_by_definition(spark):
    a, b, df = population(spark)
    u = sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(a, b))
    mw = compare.mann_whitney(df, ["k"], "g", "v").first()
    assert (mw.u, mw.n_a, mw.n_b) == (u, 5, 4)
    ks = max(abs(sum(x <= t for x in a) / 5 - sum(x <= t for x in b) / 4) for t in a + b)
    assert compare.ks_statistics(df, ["k"], "g", "v").first().ks == pytest.approx(ks)
    t = compare.t_statistics(compare.population_pairs(df, ["k"], "g", "v")).first()
    assert not t.a_greater and t.df == 7
    for test in compare.TESTS:
        assert 0 < compare.compare(df, ["k"], "g", "v", test.upper()).first().p <= 1
    with pytest.raises(ValueError):
        compare.compare(df, ["k"], "g", "v", "anova")


def test_p_values_known():
    assert compare.t_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert compare.t_p(0.5, 3) == pytest.approx(0.6514, abs=1e-4)
    assert compare.t_p(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert compare.mann_whitney_p(0, 3, 3, 0) == pytest.approx(math.erfc(4.0 / math.sqrt(2 * 9 / 12 * 7)), abs=1e-9)
    assert compare.ks_p(0.0, 5, 5) == 1.0


def test_scores_by_hand(spark):
    df = spark.createDataFrame([("s", 1, 0, 0), ("s", 1, 0, 1), ("s", 1, 2, 2), ("s", 1, None, 2)], "stack string, layer int, measured int, predicted int")
    r = compare.score(df).first()
    assert (r.n, r.error, r.percent_correct, r.MAE) == (3, pytest.approx(1 / 6), pytest.approx(2 / 3), 0.125)
    assert compare.weighted_f1(df).first().f1 == pytest.approx((2 * (2 * 1 / 3) + 1) / 3)
    assert compare.per_layer(df).count() == 1 and compare.confusion(df).count() == 3


def test_growth_and_folds(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, float("inf")), (1, 1, 2.0)], "c int, r int, v double")
    rows = {r.c: r for r in compare.growth_trend(df, "c", "r", "v").collect()}
    assert rows[0].mean == 2.0 and rows[0].sem == pytest.approx(1.0) and rows[1].mean == 2.0
    assert compare.log2_fold(df.withColumn("w", F.lit(1.0)), ["c"], "v", "w").filter("c = 0").first().log2_fold == 1.0
    assert compare.sweep_matrix(df, "c", "r", "v", [0, 1]).count() == 2


def test_concurrency_by_hand(spark):
    rows = [("A", float(x)) for x in range(6)] + [("B", 12.0), ("B", 16.0), (None, 13.0), ("A", None)]
    df = spark.createDataFrame([("s", i, g, x) for i, (g, x) in enumerate(rows)], "stack string, i int, g string, x double")
    got = {(r.g, r.x): (r.concurrent_A, r.concurrent_B) for r in regions.concurrency(df, ["stack"], "g", ["A", "B"]).collect()}
    assert got["B", 12.0] == (True, False) and got["B", 16.0] == (False, False) and got["A", 3.0][0] and not got["A", None][0]


def test_polygon(spark):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))])
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (-1.0, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(regions.inside(F.col("x"), F.col("y"), square)).collect()] == [True, False, False]
    mask = spark.range(25).select(F.lit("s").alias("s"), F.floor(F.col("id") / 5).cast("int").alias("row"), (F.col("id") % 5).cast("int").alias("col"))
    outline = regions.mask_vertices(mask, ["s"]).first().vertices
    assert len(outline) == 16
    assert regions.majority(spark.createDataFrame([(1, 2), (1, 1), (1, None)], "k int, g int"), ["k"], "g").first().g == 1


def test_distributions(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 2.0, 5.0, None)], "k string, v double")
    assert {r.v: r.share_below for r in stats.ecdf(df, ["k"], "v").collect()} == {1.0: 0.0, 2.0: 0.5, 5.0: 0.75}
    bins = stats.epdf(df, ["k"], "v", 4).collect()
    assert sum(r.n for r in bins) == 4 and sum(r.density for r in bins) == pytest.approx(1.0)
