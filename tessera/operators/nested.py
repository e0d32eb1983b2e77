"""Nested records into flat related tables, by the identity of their subtrees."""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.json import number
from tessera.session import cut

#: A task forgets which objects it has sent after so many; Spark removes what is then sent twice.
REMEMBERED = 500_000

_SPACE = re.compile(r"[ \t\n\r]*")
_OTHER = re.compile(r"[^-\d., \[\]]")
_PLAIN = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null")


class Node:
    """An object in canonical form: its identity, its scalar members and the objects below it.

    ``scalars``: (member, ordinals, type, value); ``bridges``: (member, ordinals, node). Ordinals are the
    positions in the arrays between, outermost first; none for a member that is no array.
    """

    __slots__ = ("bridges", "key", "scalars")

    def __init__(self, pairs: list[tuple[str, object]]) -> None:
        self.scalars = scalars = []
        self.bridges = bridges = []
        for name, value in sorted(dict(pairs).items()) if len(pairs) > 1 else pairs:
            if value is None:
                continue
            kind = type(value)
            if kind is Node:
                bridges.append((name, (), value))
            elif kind is not list:
                scalars.append((name, (), *_scalar(value)))
            elif (value and type(value[0]) is Node) or ((text := _numbers(value)) is None and _holds_objects(value)):
                self._enter(name, value)
            else:
                scalars.append((name, (), "array", json.dumps(_whole(value)) if text is None else text))
        own = repr((scalars, [(name, at, child.key) for name, at, child in bridges]) if bridges else scalars)
        self.key = blake2b(own.encode(), digest_size=16).digest()

    def _enter(self, name: str, array: list) -> None:
        waiting = [((), array)]
        while waiting:
            at, value = waiting.pop()
            if type(value) is Node:
                self.bridges.append((name, at, value))
            elif type(value) is list and (not at or _holds_objects(value)):
                waiting.extend(((*at, i), value[i]) for i in range(len(value) - 1, -1, -1))
            elif value is not None:
                self.scalars.append((name, at, *_scalar(value)))


def _holds_objects(array: list) -> bool:
    waiting = [array]
    while waiting:
        for x in waiting.pop():
            if type(x) is Node:
                return True
            if type(x) is list:
                waiting.append(x)
    return False


def _whole(value: object) -> object:
    """``value`` with whole numbers as such."""
    if type(value) is list:
        return [_whole(x) for x in value]
    return int(value) if type(value) is float and value.is_integer() else value


def _numbers(array: list) -> str | None:
    """The JSON of an array, however nested, that holds nothing but numbers of ordinary size; None for any other."""
    text = repr(array)
    return None if _OTHER.search(text) else text.replace(".0,", ",").replace(".0]", "]")


def _scalar(value: object) -> tuple[str, str]:
    kind = type(value)
    if kind is str:
        return "string", value
    if kind is float and value.is_integer():
        value = int(value)
    if kind is bool:
        return "boolean", "true" if value else "false"
    return ("array", json.dumps(_whole(value))) if kind is list else ("number", str(value))


def _read_deep(text: str) -> object:
    """What :func:`canonical` reads, for nesting beyond the parser's recursion: values under way stand on a list."""
    open_: list[tuple[str, list, list]] = []
    at, whole = 0, None
    skip = lambda at: _SPACE.match(text, at).end()

    def fail() -> None:
        raise ValueError("no JSON")

    def name(at: int) -> int:
        if text[at : at + 1] != '"':
            fail()
        key, at = json.decoder.scanstring(text, at + 1)
        at = skip(at)
        if text[at : at + 1] != ":":
            fail()
        open_[-1][2].append(key)
        return skip(at + 1)

    at = skip(at)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            open_.append((c, [], []))
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                at = name(at) if c == "{" else at
                continue
            value: object = None
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1)
        elif found := _PLAIN.match(text, at):
            value, at = json.loads(found[0]), found.end()
        else:
            fail()
        if c not in ("{", "["):
            whole = value
            if open_:
                open_[-1][1].append(value)
        while open_:
            at = skip(at)
            kind, values, names = open_[-1]
            if text[at : at + 1] == ",":
                at = skip(at + 1)
                at = name(at) if kind == "{" else at
                break
            if text[at : at + 1] != ("}" if kind == "{" else "]"):
                fail()
            at += 1
            open_.pop()
            whole = Node(list(zip(names, values, strict=True))) if kind == "{" else values
            if open_:
                open_[-1][1].append(whole)
        else:
            if skip(at) != len(text):
                fail()
            return whole


def canonical(text: object) -> Node | None:
    """The JSON object that ``text`` is, hashed bottom-up while it is read; None for anything else.

    Null members do not count and of members of the same name the last one does. The order of members and
    the spelling of whole numbers (3, 3.0) do not change an identity; the order of array elements and
    the arrays they stand in do. An array that holds objects, at any depth, is entered element by element
    (null elements only take up a position); one without is a value.
    """
    try:
        found = json.loads(text, object_pairs_hook=Node) if isinstance(text, str) else None
    except RecursionError:
        try:
            found = _read_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None
    return found if type(found) is Node else None


@dataclass(frozen=True)
class Flat:
    """``roots``: file_id, stack, kind, hi, lo; ``staged``: every object with the member it stands under (see :func:`objects`)."""

    roots: DataFrame
    staged: DataFrame

    @property
    def members(self) -> DataFrame:
        """One row per scalar member of a distinct object: node, member, ordinals, type, value."""
        rows = objects(self).select(identity("hi", "lo").alias("node"), F.explode("scalars").alias("s"))
        return rows.select("node", "s.*")

    @property
    def bridges(self) -> DataFrame:
        """One row per object below a distinct object: node, member, ordinals, child."""
        rows = objects(self).select(identity("hi", "lo").alias("node"), F.explode("bridges").alias("b"))
        return rows.select("node", "b.member", "b.ordinals", identity("b.hi", "b.lo").alias("child"))


STAGED = "hi bigint, lo bigint, under string, scalars array<struct<member: string, ordinals: array<int>, type: string, value: string>>, bridges array<struct<member: string, ordinals: array<int>, hi: bigint, lo: bigint>>, file_id bigint, stack string, kind string"


def _texts(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half of a surrogate pair, which JSON may spell and UTF-8 can't hold
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def _nested(parts: list, values: pa.Array) -> pa.ListArray:
    """``values`` cut into lists as long as ``parts``."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)], pa.int32()), values)


def _batch(rows: list[tuple[Node, str | None, tuple]]) -> pa.RecordBatch:
    """Objects (node, the member they stand under) and roots (node, None, file) as rows of :data:`STAGED`."""
    halves = lambda keys: np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2).T
    ordinals = lambda flat: _nested([m[1] for m in flat], pa.array([i for m in flat if m[1] for i in m[1]], pa.int32()))
    scalars = [node.scalars if under is not None else () for node, under, _ in rows]
    bridges = [node.bridges if under is not None else () for node, under, _ in rows]
    s, b = [m for part in scalars for m in part], [m for part in bridges for m in part]
    above, below = halves([node.key for node, _, _ in rows]), halves([m[2].key for m in b])
    s_columns = [_texts([m[0] for m in s]), ordinals(s), _texts([m[2] for m in s]), _texts([m[3] for m in s])]
    b_columns = [_texts([m[0] for m in b]), ordinals(b), pa.array(below[0]), pa.array(below[1])]
    files = list(zip(*(f for _, _, f in rows), strict=True))
    columns = [
        pa.array(above[0]), pa.array(above[1]), _texts([u for _, u, _ in rows]),
        _nested(scalars, pa.StructArray.from_arrays(s_columns, ["member", "ordinals", "type", "value"])),
        _nested(bridges, pa.StructArray.from_arrays(b_columns, ["member", "ordinals", "hi", "lo"])),
        pa.array(files[0], pa.int64()), _texts(files[1]), _texts(files[2]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["hi", "lo", "under", "scalars", "bridges", "file_id", "stack", "kind"])


def flatten(files: DataFrame) -> Flat:
    """Store each distinct JSON object of the bodies once, and how objects contain each other.

    Objects are canonicalised and hashed bottom-up in the tasks that read them (see :func:`canonical`), and
    written with their scalar members and bridges to the objects below them; a bridge has the child's
    identity and its ordinals. Roots have one row per file_id, whichever listing comes first by hash. Each
    occurrence of an object is a path of bridges from a root. Bodies that are null or no JSON object have
    no root; an empty table gives empty tables.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set = set()
        for batch in batches:
            rows: list = []
            gc.disable()  # trees of many small objects, none of them in a cycle
            for f, stack, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root := canonical(text)) is None:
                    continue
                rows.append((root, None, (f, stack, kind)))
                waiting = [(root, "")]
                while waiting:
                    node, under = waiting.pop()
                    if (node.key, under) not in sent:
                        sent.add((node.key, under))
                        rows.append((node, under, (None, None, None)))
                        waiting.extend((child, name) for name, _, child in node.bridges)
                if len(sent) > REMEMBERED:
                    sent.clear()
            out = _batch(rows) if rows else None
            gc.enable()
            if out is not None:
                yield out

    parsed = cut(files.select("file_id", "stack", "kind", "body").mapInArrow(read, STAGED), "subtrees")
    roots = parsed.filter("under is null").groupBy("file_id").agg(F.min(F.struct("hi", "lo", "stack", "kind")).alias("r"))
    return Flat(roots.select("file_id", "r.stack", "r.kind", "r.hi", "r.lo"), parsed.filter("under is not null").select("hi", "lo", "under", "scalars", "bridges"))


def identity(hi: str, lo: str) -> Column:
    """The identity of an object as a text."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def objects(flat: Flat, *under: str) -> DataFrame:
    """Distinct objects, once each: hi, lo, scalars, bridges. ``under``: only those that stand under one of these members ("" for roots).

    A task sends an object once for each member it stands under, so what is left to remove here is what
    several tasks or members share.
    """
    wanted = flat.staged.filter(F.col("under").isin(*under)) if under else flat.staged
    return wanted.groupBy("hi", "lo").agg(F.first("scalars").alias("scalars"), F.first("bridges").alias("bridges"))


def scalar(name: str, scalars: str = "scalars") -> Column:
    """The value of a member that is a scalar, as a text."""
    return F.get(F.filter(scalars, lambda s: (s["member"] == name) & (F.size(s["ordinals"]) == 0)), F.lit(0))["value"]


def _below(parents: DataFrame, keep: list[Column], *members: str) -> DataFrame:
    """Bridges of ``parents`` under ``members``: the kept columns, under, ordinals, hi, lo."""
    return parents.select(*keep, F.explode(F.filter("bridges", lambda b: b["member"].isin(*members))).alias("b")).select("*", F.col("b.member").alias("under"), "b.ordinals", "b.hi", "b.lo").drop("b")


def _contours(flat: Flat, kinds: list[str], more: list[str]) -> DataFrame:
    tops = flat.roots.filter(F.col("kind").isin(*kinds)).join(objects(flat, ""), ["hi", "lo"])
    at = [F.col(c) for c in ("file_id", "stack", "kind")]
    parts = []
    if "layer" in kinds:
        parts.append(_below(tops.filter("kind = 'layer'"), [*at, number(scalar("id")).alias("layer_id")], "contours"))
    if "feud" in kinds:
        layers = _below(tops.filter("kind = 'feud'"), at, "layers").drop("under", "ordinals").join(objects(flat, "layers"), ["hi", "lo"])
        parts.append(_below(layers, [*at, number(scalar("id")).alias("layer_id")], "contours"))
    found = reduce(DataFrame.unionByName, parts).drop("under").withColumnRenamed("ordinals", "contour_ordinals")
    return found.join(objects(flat, "contours"), ["hi", "lo"]).select("file_id", "stack", "kind", "layer_id", "contour_ordinals", "hi", "lo", number(scalar("id")).alias("contour_id"), *more)


def contour_rows(flat: Flat, *kinds: str) -> DataFrame:
    """Every occurrence of a contour in the documents of ``kinds`` (layer, feud), with its file and layer.

    Columns: file_id, stack, kind, layer_id, contour_ordinals, contour, contour_id. For feud the layers are those
    below the root. Ids are whole numbers, null if they are none. Both kinds share one chain of joins.
    """
    rows = _contours(flat, list(kinds), [])
    return rows.withColumn("contour", identity("hi", "lo")).drop("hi", "lo")


def leaves(flat: Flat) -> DataFrame:
    """One row per leaf of a contour occurrence: file_id, layer_id, contour_id, leaf, type, value.

    Colour leaves are ``color_avg.CHANNEL`` and ``color_std.CHANNEL`` in either shape, an object by channel or an array of
    {channel, value}; an object as value has its identity. Labels that are neither null nor blank are the leaves
    of feud documents.
    """
    at = ["file_id", "layer_id", "contour_id"]
    found = _contours(flat, ["layer", "feud"], ["scalars", "bridges"])
    label = scalar("label")
    labels = found.filter("kind = 'feud'").withColumn("value", label).filter(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    colors = _below(found.filter("kind = 'layer'"), [F.col(c) for c in at], "color_avg", "color_std").join(objects(flat, "color_avg", "color_std"), ["hi", "lo"])
    leaf = lambda name, kind, value: F.struct(name.alias("channel"), kind.alias("type"), value.alias("value"))
    members = F.concat(
        F.transform("scalars", lambda s: leaf(s["member"], s["type"], s["value"])),
        F.transform("bridges", lambda b: leaf(b["member"], F.lit("object"), F.lower(F.concat(F.lpad(F.hex(b["hi"]), 16, "0"), F.lpad(F.hex(b["lo"]), 16, "0"))))),
    )
    entry = F.transform(F.filter(members, lambda m: m["channel"] == "value"), lambda m: leaf(scalar("channel"), m["type"], m["value"]))
    channels = colors.select(*at, "under", F.explode(F.when(F.size("ordinals") == 0, members).otherwise(entry)).alias("c")).filter("c.channel is not null")
    by_channel = channels.select(*at, F.concat_ws(".", "under", "c.channel").alias("leaf"), "c.type", "c.value")
    return by_channel.unionByName(labels.select(*at, F.lit("label").alias("leaf"), F.lit("string").alias("type"), "value"))
