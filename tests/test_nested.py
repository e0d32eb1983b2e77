import json

import brute

from tessera.operators import nested

SCHEMA = "file_id bigint, stack string, kind string, body string, node string, member string"


def files(spark, rows):
    return spark.createDataFrame([(f, "s", k, b if b is None or isinstance(b, str) else json.dumps(b), "n", "m") for f, k, b in rows], SCHEMA)


SAME = {"id": 7, "color_avg": {"r": 1, "g": None, "b": {"v": 2}}, "color_std": [{"channel": "r", "value": "x"}, {"channel": "g", "value": None}], "points": [[1, 2]]}
ROWS = [
    (1, "layer", {"id": 1, "contours": [SAME, {"id": "8", "color_avg": {}}, None, SAME | {"id": 7.0}]}),
    (2, "layer", {"contours": [SAME], "id": 1}),
    (2, "layer", {"contours": [SAME], "id": 1}),
    (3, "layer", {"id": 1, "contours": None}),
    (4, "layer", "broken"),
    (5, "layer", None),
    (6, "layer", ""),
    (7, "feud", {"layers": [{"id": "1", "contours": [{"id": 1, "label": "M"}, {"id": 2, "label": " "}, {"id": 3, "label": None}, {"id": 4}]}, {"id": 2, "contours": []}]}),
    (8, "layer", {"id": 2, "contours": [{"id": i, "color_avg": {"r": i}} for i in range(3000)]}),
    (9, "layer", {"id": 3}),
]


def test_leaves_against_brute_force(spark):
    df = files(spark, ROWS)
    got = {(r.file_id, r.layer_id, r.contour_id, r.leaf) for r in nested.leaves(nested.flatten(df)).collect()}
    assert got == brute.p5([r.asDict() for r in df.collect()])


def test_identical_objects_are_stored_once(spark):
    flat = nested.flatten(files(spark, ROWS))
    assert flat.roots.groupBy("file_id").count().filter("count > 1").count() == 0
    assert flat.members.groupBy("node", "member", "ordinals").count().filter("count > 1").count() == 0
    assert flat.bridges.groupBy("node", "member", "ordinals").count().filter("count > 1").count() == 0
    same = nested.contour_rows(flat, "layer").filter("contour_id = 7 and file_id < 3").collect()
    assert len(same) == 3 and len({r.contour for r in same}) == 1
    assert {tuple(r.contour_ordinals) for r in same if r.file_id == 1} == {(0,), (3,)}


def test_identity_ignores_order_of_members_but_not_of_elements():
    h = lambda o: nested.canonical(json.dumps(o)).key
    assert h({"a": 1, "b": {"c": 2.0}}) == h({"b": {"c": 2}, "a": 1, "z": None})
    assert h({"a": [{"x": 1}, {"y": 1}]}) != h({"a": [{"y": 1}, {"x": 1}]})
    assert h({"a": 1}) != h({"a": "1"}) and h({"a": True}) != h({"a": 1})
    assert h({"a": [[{"x": 1}], [{"x": 2}]]}) != h({"a": [[{"x": 1}, {"x": 2}]]})


def test_objects_in_arrays_of_arrays_are_kept(spark):
    body = {"layers": [[{"id": 1, "contours": [[{"id": 5, "label": "M"}], [None, {"id": 6, "label": "H"}, 3]]}]]}
    flat = nested.flatten(files(spark, [(1, "feud", body)]))
    assert {(r.layer_id, r.contour_id, r.leaf, r.value) for r in nested.leaves(flat).collect()} == {(1, 5, "label", "M"), (1, 6, "label", "H")}
    assert {(r.member, tuple(r.ordinals)) for r in flat.bridges.collect()} == {("layers", (0, 0)), ("contours", (0, 0)), ("contours", (1, 1))}
    assert {r.value for r in flat.members.filter("member = 'contours'").collect()} == {"3"}


def test_nesting_of_any_depth(spark):
    deep = lambda n: '{"a": [' * n + '{"id": 7, "z": [1, {"q": null}]}' + "]}" * n
    assert nested.canonical(deep(5000)) is not None and nested.canonical(deep(40_000)) is not None
    flat = nested.flatten(files(spark, [(1, "layer", deep(20_000)), (2, "layer", deep(20_000)[:-1]), (3, "layer", '{"a": "\\ud800"}')]))
    assert {r.file_id for r in flat.roots.collect()} == {1, 3} and flat.bridges.filter("member = 'a'").count() == 20_000


def test_deep_reader_equals_the_parser():
    good = ['{"a": {"b": [1, 2.0, true, null, "x\\n\\u00e9"]}, "c": [], "d": {}, "a": [[{}, {"k": -1e3}], []]}', ' {"x" : [ { } , [ ] ] } ', "{}"]
    for text in good:
        assert nested._read_deep(text).key == nested.canonical(text).key
    for text in ("", "{", '{"a"}', '{"a": 1,}', "[1,]", '{"a": 01}', '{"a": 1} x', "{'a': 1}", "{1: 2}"):
        try:
            nested._read_deep(text)
        except ValueError:
            continue
        raise AssertionError(text)


def test_empty(spark):
    assert nested.leaves(nested.flatten(files(spark, []))).count() == 0
