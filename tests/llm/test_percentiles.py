import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import percentiles


def values(spark, groups):
    return spark.createDataFrame([(k, float(v) if v is not None else None, 1) for k, vs in groups for v in vs], "k string, v double, n int").repartition(6)


def exact(vs, pct):
    s = sorted(vs)
    return s[math.ceil(pct / 100 * len(s)) - 1]


def test_error_stays_in_the_bound(spark):
    rng = np.random.default_rng(0)
    groups = [("hot", rng.lognormal(size=60_000)), ("ties", [1.0] * 5000 + [2.0] * 5000), ("few", rng.random(300)), (None, [3.0, 1.0]), ("dirt", [None, float("nan"), float("inf"), -float("inf"), 5.0])]
    done = percentiles.sketch(values(spark, groups), ["k"], "v", k=256)
    assert {r.k: r.n for r in done.collect()} == {"hot": 60_000, "ties": 10_000, "few": 300, None: 2, "dirt": 1}
    got = {(r.k, r.pct): r for r in percentiles.percentiles(done, ["k"], [10, 50, 90]).collect()}
    for k, vs in groups[:3]:
        for pct in (10, 50, 90):
            r = got[k, pct]
            assert r.low <= exact(vs, pct) <= r.high
            rank = np.searchsorted(np.sort(vs), r.value, side="right")
            assert np.searchsorted(np.sort(vs), r.value) - r.rank_error <= math.ceil(pct / 100 * len(vs)) <= rank + r.rank_error
    assert got["hot", 50].rank_error < 0.1 * 60_000
    assert got[None, 50].value == 1.0 and got["dirt", 90].value == 5.0 and got[None, 90].rank_error == 0


def test_weights_are_kept_and_merging_is_levelwise(spark):
    rng = np.random.default_rng(1)
    df = values(spark, [(f"d{i % 40}", [x]) for i, x in enumerate(rng.random(20_000))])
    days = percentiles.sketch(df, ["k"], "v", k=64)
    month = percentiles.merge(days.withColumn("m", F.lit("m")), ["m"], k=64).first()
    assert month.n == 20_000 == sum(len(x) << h for h, x in enumerate(month.levels))
    assert all(len(x) <= 64 for x in month.levels)
    r = percentiles.percentiles(percentiles.merge(days.withColumn("m", F.lit("m")), ["m"], k=64), ["m"], [50]).first()
    assert abs(r.value - 0.5) < 0.05 and r.low <= 0.5 <= r.high + 0.02


def test_exact_check(spark):
    rng = np.random.default_rng(2)
    data = [("a", rng.random(5000)), ("b", [7.0] * 4000)]
    df = values(spark, data)
    asked = percentiles.percentiles(percentiles.sketch(df, ["k"], "v", k=64), ["k"], [10, 50, 90])
    got = {(r.k, r.pct): r.value for r in percentiles.exact_percentiles(df, ["k"], "v", asked).collect()}
    assert got == {(k, p): exact(vs, p) for k, vs in data for p in (10, 50, 90)}


def test_bound_by_simulation():
    rng = np.random.default_rng(5)
    off = []
    for _ in range(60):
        c = percentiles.Compactors()
        data = rng.random(4000)
        for part in np.array_split(data, 40):
            c.add(part)
            c.n += len(part)
            c.compact(rng, 64)
        items = np.concatenate(c.levels)
        weights = np.concatenate([np.full(len(x), 1 << h) for h, x in enumerate(c.levels)])
        off.append(abs(weights[items <= 0.5].sum() - (data <= 0.5).sum()) / percentiles.rank_bound(c.err2, 0.05))
    assert np.mean(np.array(off) <= 1) >= 0.9


def test_missed_brackets_are_taken_again(spark):
    rng = np.random.default_rng(3)
    data = [("a", rng.random(500)), ("b", rng.random(400))]
    df = values(spark, data)
    asked = spark.createDataFrame([(k, len(vs), p, *((2.0, 3.0) if k == "a" else (0.0, 1.0))) for k, vs in data for p in (10, 50)], "k string, n bigint, pct int, low double, high double")
    got = {(r.k, r.pct): r.value for r in percentiles.exact_percentiles(df, ["k"], "v", asked).collect()}
    assert got == {(k, p): exact(vs, p) for k, vs in data for p in (10, 50)}


def test_chunks_and_tasks_choose_independently(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "HELD", 1000)
    monkeypatch.setattr(percentiles, "merge", lambda sketches, *args, **settings: sketches)
    same = spark.range(64 * 1000, numPartitions=8).select(F.lit("k").alias("k"), (F.col("id") % 1000).cast("double").alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        rows = percentiles.sketch(same, ["k"], "v", k=64).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 64 and all(r.n == 1000 for r in rows)
    assert len({str(r.levels) for r in rows}) > 8


def test_equal_groups_of_a_task_choose_independently(spark):
    same = spark.range(64 * 3000, numPartitions=1).select((F.col("id") % 64).cast("string").alias("k"), F.floor(F.col("id") / 64).cast("double").alias("v"))
    parts = percentiles.sketch(same.withColumn("p", F.floor(F.col("v") / 300)), ["k", "p"], "v", k=200)
    rows = percentiles.merge(parts.repartition(1), ["k"], k=200).collect()
    assert len(rows) == 64 and all(r.n == 3000 for r in rows)
    assert len({str(r.levels) for r in rows}) > 48


def test_empty(spark):
    df = values(spark, [])
    done = percentiles.sketch(df, ["k"], "v")
    assert done.count() == 0 and percentiles.percentiles(done, ["k"], [50]).count() == 0 and percentiles.merge(done, ["k"]).count() == 0


def test_readings_count_a_cell_once(spark):
    df = spark.createDataFrame([(1, "s", 1, 0.5), (1, "s", 1, 0.5), (2, "s", 1, None), (3, "s", None, 0.2), (4, "s", 1, 1.0), (None, "s", 1, 0.5), (1, "t", 2, 0.4)], "cell_id bigint, stack string, layer int, clonal_marker double").withColumn("measured_at", F.current_timestamp())
    assert sorted((r.cell_id, r.clonal_marker) for r in percentiles.readings(df).collect()) == [(1, pytest.approx(0.4)), (3, pytest.approx(0.2))]
