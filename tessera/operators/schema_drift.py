"""Files whose fields are added, renamed, removed or retyped over time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.json import bound, number, strict_object
from tessera.operators.ordering import with_previous
from tessera.session import cut

#: The promotion lattice: two types and what they become where they meet. A type meets itself in itself, whatever is not listed in ``string``.
LATTICE = {("boolean", "number"): "number", ("number", "boolean"): "number"}
#: How a type of the lattice is stored in the union table.
STORED = {"number": "double", "boolean": "boolean", "object": "variant", "array": "variant", "string": "string"}
#: Kinds of files that have a header here.
KINDS = ("metadata", "layer")
#: Fields a union schema may have; it is held by the driver, as any schema is.
MOST_FIELDS = 10_000


ENTRIES = "array<struct<field:string,type:string,text:string>>"


def _no(kind: str) -> Column:
    return F.array().cast(kind)


def promoted(types: Column) -> Column:
    """The least type that holds all of an array of types: the array folded through :data:`LATTICE`; null for none."""
    meets = F.create_map(*[F.lit(x) for (a, b), c in LATTICE.items() for x in (f"{a} {b}", c)])
    meet = lambda a, b: F.when(a.isNull() | (a == b), b).otherwise(F.coalesce(F.try_element_at(meets, F.concat_ws(" ", a, b)), F.lit("string")))
    return F.aggregate(types, F.lit(None).cast("string"), meet)


def json_type(value: Column) -> Column:
    """number, string, boolean, object or array of a VARIANT; null for null."""
    named = lambda n: F.when(n.startswith("OBJECT"), "object").when(n.startswith("ARRAY"), "array").when(n == "STRING", "string").when(n == "BOOLEAN", "boolean").when(n != "VOID", "number")
    return bound(F.schema_of_variant(value), named)


def _entry(field: Column, value: Column) -> Column:
    return F.struct(field.alias("field"), json_type(value).alias("type"), F.try_variant_get(value, "$", "string").alias("text"))


def _members(of: Column, prefix: str) -> Column:
    """Entries of the non-null members of a VARIANT that is an object; null for any other."""
    entries = F.transform(F.map_entries(F.try_variant_get(of, "$", "map<string,variant>")), lambda m: _entry(F.concat(F.lit(prefix), m["key"]), m["value"]))
    return F.filter(entries, lambda e: e["type"].isNotNull())


def _channels(of: Column, prefix: str) -> Column:
    """Entries of an array of {channel, value}; of entries for the same channel the first counts. Null for no array."""
    pairs = F.transform(
        F.try_variant_get(of, "$", "array<variant>"),
        lambda e: _entry(F.concat(F.lit(prefix), F.try_variant_get(e, "$.channel", "string")), F.try_variant_get(e, "$.value", "variant")),
    )
    known = F.filter(pairs, lambda e: e["field"].isNotNull() & e["type"].isNotNull())
    return bound(known, lambda all_: bound(F.transform(all_, lambda x: x["field"]), lambda fields: F.filter(all_, lambda e, i: F.array_position(fields, e["field"]) == i + 1)))


def _contour(contour: Column, at: Column) -> Column:
    """A contour's row: its ordinal and id, and the entries of its colours; the colour map itself is one if it has any."""
    own = lambda colors: F.array(F.struct(F.lit("color_avg").alias("field"), json_type(colors).alias("type"), F.lit(None).cast("string").alias("text")))
    entries = lambda colors: F.coalesce(_members(colors, "color_avg."), _channels(colors, "color_avg."), _no(ENTRIES))
    found = bound(F.try_variant_get(contour, "$.color_avg", "variant"), lambda colors: bound(entries(colors), lambda e: F.when(F.size(e) > 0, F.concat(own(colors), e)).otherwise(e)))
    return F.struct(at.cast("int").alias("ordinal"), number(F.try_variant_get(contour, "$.id", "string")).alias("contour_id"), found.alias("entries"))


def headers(files: DataFrame) -> DataFrame:
    """What each file holds and under which schema, read in parallel: file_id, stack, kind, written_at, found (MAP field to type), rows.

    ``rows`` starts with the file's own row (ordinal null) and goes on with one per contour that has
    colours: (ordinal, contour_id, entries (field, type, text)). Fields are ``params.NAME`` of metadata,
    ``color_avg`` and ``color_avg.CHANNEL`` of layer documents; a field's types within a file are folded through
    the lattice. Files of other kinds, bodies that are null or not exactly one JSON object (or nested more
    than 1,000 deep), and layer documents without any colour have no header. A file_id counts once.
    Nulls do not exist. Bodies are read as VARIANT where the files are.
    """
    wanted = files.filter(F.col("kind").isin(*KINDS)).select("file_id", "stack", "kind", "written_at", strict_object(F.col("body")).alias("v")).filter("v is not null")
    contours = F.transform(F.try_variant_get("v", "$.contours", "array<variant>"), _contour)
    params = F.coalesce(_members(F.try_variant_get("v", "$.params", "variant"), "params."), _no(ENTRIES))
    own = lambda entries: F.array(F.struct(F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("bigint").alias("contour_id"), entries.alias("entries")))
    inside = F.filter(F.coalesce(contours, _no(f"array<struct<ordinal:int,contour_id:bigint,entries:{ENTRIES}>>")), lambda r: F.size(r["entries"]) > 0)
    rows = F.when(F.col("kind") == "metadata", own(params)).otherwise(F.concat(own(_no(ENTRIES)), inside))
    once = wanted.select("file_id", "stack", "kind", "written_at", rows.alias("rows")).groupBy("file_id").agg(F.min(F.struct("written_at", "stack", "kind", "rows")).alias("h"))
    entries = F.flatten(F.transform("h.rows", lambda r: r["entries"]))
    folded = lambda all_: F.map_from_entries(
        F.transform(F.array_distinct(F.transform(all_, lambda e: e["field"])), lambda f: F.struct(f, promoted(F.array_distinct(F.transform(F.filter(all_, lambda e: e["field"] == f), lambda e: e["type"])))))
    )
    read = once.withColumn("_all", entries).select("file_id", "h.stack", "h.kind", "h.written_at", folded(F.col("_all")).alias("found"), "h.rows")
    return read.filter((F.col("kind") == "metadata") | (F.size("found") > 0))


def union_schema(read: DataFrame) -> DataFrame:
    """The headers of all files folded through the lattice: kind, field, union_type, stored_as, types, n_files, first_file, last_file.

    A set of types per field is gathered in each task and merged after the shuffle; it has at most five.
    """
    seen = read.select("kind", "file_id", F.explode("found").alias("field", "type"))
    kinds = seen.groupBy("kind", "field").agg(F.sort_array(F.collect_set("type")).alias("types"), F.count("*").alias("n_files"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))
    stored = F.create_map(*[F.lit(x) for pair in STORED.items() for x in pair])
    return kinds.withColumn("union_type", promoted(F.col("types"))).select("kind", "field", "union_type", F.element_at(stored, F.col("union_type")).alias("stored_as"), "types", "n_files", "first_file", "last_file")


def _cast(text: Column, union_type: str) -> Column:
    if union_type == "number":
        return F.coalesce(text.try_cast("double"), text.try_cast("boolean").cast("double"))
    if union_type == "boolean":
        return text.try_cast("boolean")
    return text if union_type == "string" else F.try_parse_json(text)


@dataclass(frozen=True)
class Conformed:
    """``schema``: see :func:`union_schema`; ``table``: see :func:`conform`; ``columns``: (kind, field, union type) of its columns f0, f1, ..."""

    schema: DataFrame
    table: DataFrame
    columns: list[tuple[str, str, str]]


def conform(files: DataFrame) -> Conformed:
    """Cast all files to their union schema: one table, a row per file and a row per contour with colours.

    Columns: file_id, stack, kind, written_at, ordinal and contour_id (null in a file's own row), found (the
    header as read, in a file's own row), and a column for each field, of its stored type: f0, f1, ... in
    order of kind and field, since field names may hold any character or differ in case only. A colour
    map itself has no column. An empty table gives an empty table without fields.
    Raises ValueError beyond :data:`MOST_FIELDS` fields.
    """
    read = cut(headers(files), "headers")
    schema = cut(union_schema(read), "schema")
    listed = schema.select("kind", "field", "union_type").orderBy("kind", "field").limit(MOST_FIELDS + 1).collect()
    if len(listed) > MOST_FIELDS:
        raise ValueError(f"the files have more than {MOST_FIELDS} fields")
    columns = [(r["kind"], r["field"], r["union_type"]) for r in listed if r["field"] != "color_avg"]
    rows = read.select("file_id", "stack", "kind", "written_at", "found", F.explode("rows").alias("r"))
    texts = rows.select(
        "file_id", "stack", "kind", "written_at", "r.ordinal", "r.contour_id", F.when(F.col("r.ordinal").isNull(), F.col("found")).alias("found"),
        F.map_from_entries(F.transform("r.entries", lambda e: F.struct(e["field"], e["text"]))).alias("_t"),
    )
    cast = texts.select(*[c for c in texts.columns if c != "_t"], *[_cast(F.try_element_at("_t", F.lit(field)), kind).alias(f"f{i}") for i, (_, field, kind) in enumerate(columns)])
    return Conformed(schema, cut(cast, "conformed"), columns)


def _changes(before: Column, now: Column) -> Column:
    gone, new = F.array_except(F.map_keys(before), F.map_keys(now)), F.array_except(F.map_keys(now), F.map_keys(before))
    both = F.array_intersect(F.map_keys(before), F.map_keys(now))
    entry = lambda kind: lambda f: F.struct(f.alias("field"), F.lit(kind).alias("change_kind"), F.try_element_at(before, f).alias("type_before"), F.try_element_at(now, f).alias("type"))
    retyped = F.transform(F.filter(both, lambda f: F.element_at(before, f) != F.element_at(now, f)), entry("retyped"))
    renamed = F.transform(new, lambda f: F.struct(f.alias("field"), F.lit("renamed").alias("change_kind"), F.element_at(before, F.element_at(gone, 1)).alias("type_before"), F.element_at(now, f).alias("type")))
    moved = F.when((F.size(gone) == 1) & (F.size(new) == 1), renamed)
    return F.concat(retyped, F.coalesce(moved, F.concat(F.transform(gone, entry("removed")), F.transform(new, entry("added")))))


def drift(done: Conformed) -> DataFrame:
    """The log of changes: every difference between a file of the conformed table and the one before it in its series (stack, kind).

    Returns file_id, stack, kind, written_at, field, change_kind, type_before, type, union_type. change_kind is
    ``retyped``; ``renamed`` (with the new name) if exactly one field is gone and exactly one is new; else
    ``removed`` and ``added``. Files are in order of written_at, ties by file_id, a missing written_at comes first;
    a null stack is a series. The first file of a series, and an empty table, has no changes. A series of any
    length is compared in chunks (see :func:`with_previous`).
    """
    own = done.table.filter("ordinal is null").select("file_id", "stack", "kind", "written_at", "found")
    pairs = with_previous(own, ["stack", "kind"], ["written_at", "file_id"], "found", "before")
    changed = pairs.filter("before is not null").withColumn("c", F.explode(_changes(F.col("before"), F.col("found")))).select("file_id", "stack", "kind", "written_at", "c.*")
    return changed.join(F.broadcast(done.schema.select("kind", "field", "union_type")), ["kind", "field"])


def values(done: Conformed) -> DataFrame:
    """The conformed table as name and value: file_id, kind, contour_id, field, union_type, number_value, boolean_value, text_value.

    A value stands in the column of its field's union type; objects and arrays as JSON in text_value.
    """
    if not done.columns:
        return done.table.select("file_id", "kind", "contour_id", *[F.lit(None).cast(t).alias(c) for c, t in (("field", "string"), ("union_type", "string"), ("number_value", "double"), ("boolean_value", "boolean"), ("text_value", "string"))]).limit(0)
    cell = lambda i, kind: F.when(F.col(f"f{i}").isNotNull(), F.struct(
        F.lit(done.columns[i][1]).alias("field"), F.lit(kind).alias("union_type"), (F.col(f"f{i}") if kind == "number" else F.lit(None).cast("double")).alias("number_value"),
        (F.col(f"f{i}") if kind == "boolean" else F.lit(None).cast("boolean")).alias("boolean_value"),
        (F.col(f"f{i}") if kind == "string" else F.to_json(f"f{i}") if kind in ("object", "array") else F.lit(None).cast("string")).alias("text_value"),
    ))
    cells = F.array_compact(F.array(*[cell(i, kind) for i, (_, _, kind) in enumerate(done.columns)]))
    return done.table.select("file_id", "kind", "contour_id", F.explode(cells).alias("c")).select("file_id", "kind", "contour_id", "c.*")
