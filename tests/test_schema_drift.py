import json
from datetime import datetime, timedelta

import brute
from pyspark.sql import functions as F

from tessera.operators import schema_drift
from tessera.operators.ordering import running_totals, with_previous

SCHEMA = "file_id bigint, stack string, kind string, layer int, written_at timestamp, arrived_at timestamp, deleted_at timestamp, body string, field string, before int, _chunk int"


def files(spark, rows):
    at = lambda k: None if k is None else datetime(2024, 1, 1) + timedelta(hours=k)
    return spark.createDataFrame([(f, s, kind, None, at(k), None, None, body if body is None or isinstance(body, str) else json.dumps(body), "f", 1, 2) for f, s, kind, k, body in rows], SCHEMA)


def layer(*colors):
    return {"id": 1, "contours": [{"id": i, "color_avg": c} for i, c in enumerate(colors)]}


ROWS = [
    (1, "s", "metadata", 1, {"params": {"a": 1, "b": "x", "c": None}}),
    (2, "s", "metadata", 2, {"params": {"a": "1", "b": "x"}}),
    (3, "s", "metadata", 3, {"params": {"a": "1", "bb": "x"}}),
    (3, "s", "metadata", 3, {"params": {"a": "1", "bb": "x"}}),
    (5, "s", "metadata", 4, {"params": {"d": [1], "e": True}}),
    (4, "s", "metadata", 4, {"params": {"d": {}, "e": True}}),
    (6, "s", "metadata", None, {"params": {"z": 1}}),
    (7, "s", "metadata", 6, {}),
    (8, "s", "metadata", 7, "broken {"),
    (9, "s", "metadata", 8, None),
    (10, None, "metadata", 1, {"params": {"q": 1}}),
    (11, None, "metadata", 2, {"params": {"q": 1, "r": 1}}),
    (20, "s", "layer", 1, layer({"r": 1, "g": 2})),
    (21, "s", "layer", 2, layer({}, [], None)),
    (22, "s", "layer", 3, layer([{"channel": "r", "value": 1}, {"channel": "g", "value": None}])),
    (23, "s", "layer", 4, layer({"r": None})),
    (24, "s", "layer", 5, layer({"r": "1"}, {"k": {"v": 1}})),
    (25, "s", "layer", 6, {"id": 1, "contours": None}),
    (26, "s", "feud", 6, {"layers": []}),
]


def test_changes_against_brute_force(spark):
    df = files(spark, ROWS)
    log = schema_drift.drift(schema_drift.conform(df)).collect()
    got = {(r.file_id, r.field, r.change_kind) for r in log}
    assert {(r.type_before, r.type, r.union_type) for r in log if r.file_id == 2} == {("number", "string", "string")}
    rows = [r for r in (x.asDict() for x in df.collect())]
    assert got == brute.p3(rows)
    assert {(2, "params.a", "retyped"), (3, "params.bb", "renamed"), (11, "params.r", "added"), (22, "color_avg", "retyped"), (7, "params.d", "removed")} <= got


def test_union_schema_and_values(spark):
    df = files(spark, ROWS)
    kinds = {(r.kind, r.field): r.union_type for r in schema_drift.union_schema(schema_drift.headers(df)).collect()}
    assert kinds["metadata", "params.a"] == "string" and kinds["metadata", "params.z"] == "number" and kinds["metadata", "params.d"] == "string"
    assert kinds["layer", "color_avg"] == "string" and kinds["layer", "color_avg.k"] == "object"
    done = schema_drift.conform(df)
    found = schema_drift.values(done).collect()
    assert {(r.file_id, r.number_value) for r in found if r.field == "params.z"} == {(6, 1.0)}
    assert {r.text_value for r in found if r.field == "params.a"} == {"1"}
    assert {(r.file_id, r.contour_id, r.text_value) for r in found if r.field in ("color_avg.k", "color_avg.r")} == {(20, 0, "1"), (22, 0, "1"), (24, 0, "1"), (24, 1, '{"v":1}')}
    stored = dict(done.table.dtypes)
    assert {stored[f"f{i}"] for i, (_, _, kind) in enumerate(done.columns) if kind == "number"} == {"double"}
    assert done.table.filter("ordinal is null").count() == len({r.file_id for r in done.table.select("file_id").collect()})


def test_fold_is_that_of_the_lattice_in_any_order(spark):
    sets = [["number", "boolean"], ["boolean", "number"], ["number"], ["boolean", "number", "string"], ["object", "array"], ["array"], []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, t array<string>")
    assert [r.p for r in df.select("i", schema_drift.promoted(F.col("t")).alias("p")).orderBy("i").collect()] == ["number", "number", "number", "string", "string", "array", None]


def test_same_channel_twice_and_odd_names(spark):
    rows = [(1, "s", "layer", 1, layer([{"channel": "r", "value": 1}, {"channel": "r", "value": "x"}, {"channel": None, "value": 1}, 3, None])), (2, "s", "metadata", 1, {"params": {"a.b": 1, "A.B": True, "`": [1]}})]
    found = {(r.field, r.number_value, r.boolean_value, r.text_value) for r in schema_drift.values(schema_drift.conform(files(spark, rows))).collect()}
    assert found == {("color_avg.r", 1.0, None, None), ("params.a.b", 1.0, None, None), ("params.A.B", None, True, None), ("params.`", None, None, "[1]")}


def test_empty(spark):
    df = files(spark, [])
    done = schema_drift.conform(df)
    assert schema_drift.drift(done).count() == done.schema.count() == schema_drift.values(done).count() == done.table.count() == 0


def test_previous_in_a_group_that_holds_nearly_all_rows(spark):
    rows = [("hot", i, f"v{i}") for i in range(5000)] + [("a", 1, "x"), (None, 1, "y"), (None, 2, "z")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    got = {(r.k, r.o): r.p for r in with_previous(df, ["k"], ["o"], "v", "p").collect()}
    assert all(got["hot", i] == (f"v{i - 1}" if i else None) for i in range(5000))
    assert got["a", 1] is None and got[None, 1] is None and got[None, 2] == "y"


def test_running_totals_in_a_group_that_holds_nearly_all_rows(spark):
    rows = [("hot", i, i % 7) for i in range(4000)] + [(None, 1, 5), (None, 2, None), ("a", 0, 2)]
    got = {(r.k, r.o): (r.v_upto, r.v_all) for r in running_totals(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], ["o"], ["v"]).collect()}
    total = 0
    for i in range(4000):
        total += i % 7
        assert got["hot", i][0] == total
    assert got["hot", 0][1] == total and got[None, 1] == (5, 5) and got[None, 2] == (5, 5) and got["a", 0] == (2, 2)
