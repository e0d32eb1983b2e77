from collections import Counter

from tessera.operators import orphans
from tessera.operators.orphans import orphan_references
from tessera.session import cut, settings

KEY = ["stack", "ref_id"]


def run(spark, refs, targets, most=10_000):
    r = spark.createDataFrame(refs, "stack string, ref_id bigint, month string, row_key bigint, n_refs int, _n int")
    t = spark.createDataFrame(targets, "stack string, ref_id bigint, row_key string, month int")
    found = orphan_references(r, t, KEY, "month", most)
    return Counter(x.row_key for x in found.rows.collect()), {(x.stack, x.ref_id, x.month): x.n_refs for x in found.counts.collect()}


def test_hot_keys_and_nulls(spark):
    refs = [("hot", 1, f"m{i % 2}", i, 0, 0) for i in range(3000)] + [("hotlive", 1, "m0", 10_000 + i, 0, 0) for i in range(3000)]
    refs += [("a", 1, "m0", 1, 0, 0), ("a", 2, None, 2, 0, 0), ("a", 2, None, 2, 0, 0), (None, 3, "m0", 3, 0, 0), ("a", None, "m0", 4, 0, 0)]
    targets = [("hotlive", 1, "x", 1), ("a", 1, "x", 1), ("a", 1, "x", 1), (None, 3, "x", 1), ("b", 2, "x", 1)]
    rows, counts = run(spark, refs, targets, most=3)
    want = Counter(range(3000)) + Counter([2, 2, 3, 4])
    assert rows == want
    assert counts == {("hot", 1, "m0"): 1500, ("hot", 1, "m1"): 1500, ("a", 2, None): 2, (None, 3, "m0"): 1, ("a", None, "m0"): 1}


def test_both_sides_of_the_split_find_orphans(spark):
    refs = [("s", i % 40, "m", i, 0, 0) for i in range(400)] + [("s", 1000 + i, "m", 1000 + i, 0, 0) for i in range(300)]
    targets = [("s", k, "x", 1) for k in range(20)] + [("s", 1000 + k, "x", 1) for k in range(0, 300, 2)]
    r = spark.createDataFrame(refs, "stack string, ref_id bigint, month string, row_key bigint, n_refs int, _n int")
    t = spark.createDataFrame(targets, "stack string, ref_id bigint, row_key string, month int")
    found = orphan_references(r, t, KEY, "month", most_heavy=100)
    assert {(x.ref_id, x.heavy, x.n_refs) for x in found.counts.collect()} == {(k, True, 10) for k in range(20, 40)} | {(1000 + k, False, 1) for k in range(1, 300, 2)}
    assert {x.row_key for x in found.rows.collect()} == {i for i in range(400) if i % 40 >= 20} | {1000 + k for k in range(1, 300, 2)}


def test_empty_sides(spark):
    assert run(spark, [], [("a", 1, "x", 1)]) == (Counter(), {})
    assert run(spark, [("a", 1, "m", 5, 0, 0)], []) == (Counter([5]), {("a", 1, "m"): 1})


def test_targets_and_light_keys_are_never_broadcast(spark, monkeypatch):
    """Few bytes of files may be many rows, so the size that Spark reckons must not decide."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans = {}
    monkeypatch.setattr(orphans, "cut", lambda df, name: plans.setdefault(name, plan(df)) and cut(df, name))
    refs = spark.range(100).selectExpr("'s' AS stack", "id AS ref_id", "'m' AS month", "id AS row_key")
    targets = spark.range(1).selectExpr("'s' AS stack", "explode(sequence(0L, 89L)) AS ref_id")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="1g"):
        found = orphan_references(refs, targets, KEY, "month")
        assert "SortMergeJoin" in plans["orphans"] and "SortMergeJoin" in plan(found.rows)
        assert {x.row_key for x in found.rows.collect()} == set(range(90, 100))
