"""Queries of the general data-preparation operators (problems 2, 3, 5 and 6)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.json import number
from tessera.operators import nested, schema_drift, small_files
from tessera.operators.orphans import Orphans, orphan_references
from tessera.session import cut, load, scratch

KEY = ["ref_field", "stack", "layer", "ref_id"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    done = small_files.consolidate(spark, f"{d}/segment_files.parquet")
    return small_files.repeated(done).select("file_id", F.col("line_no").cast("int").alias("line_no"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    done = small_files.consolidate(spark, f"{d}/segment_files.parquet")
    return done.kept.select("stack", "layer", "segment_id", "depth", "file_id", F.col("line_no").cast("int").alias("line_no"), "record")


def p2_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The files of a table of any content rewritten as few: nothing lost or doubled."""
    packed = small_files.compact_folder(spark, f"{d}/segment_files.parquet", scratch(spark, "compacted"))
    return spark.read.parquet(packed.path).select("file_id", "path", "stack", "size_bytes", F.length("content").alias("n_chars"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift(schema_drift.conform(load(spark, d, "silhouette_files"))).select("file_id", "field", "change_kind")


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    """The log with types before and after, and the type that holds both."""
    return schema_drift.drift(schema_drift.conform(load(spark, d, "silhouette_files"))).drop("written_at")


def p3_schema(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.union_schema(schema_drift.headers(load(spark, d, "silhouette_files"))).withColumn("types", F.concat_ws(",", "types"))


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.values(schema_drift.conform(load(spark, d, "silhouette_files")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = nested.leaves(nested.flatten(load(spark, d, "silhouette_files")))
    return found.select("file_id", F.col("layer_id").cast("int").alias("layer_id"), F.col("contour_id").cast("int").alias("contour_id"), "leaf").distinct()


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(load(spark, d, "silhouette_files")).members.withColumn("ordinals", F.concat_ws(".", "ordinals"))


def p5_bridges(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(load(spark, d, "silhouette_files")).bridges.withColumn("ordinals", F.concat_ws(".", "ordinals"))


def _references(spark: SparkSession, d: str) -> Orphans:
    cells, layers = load(spark, d, "cell_measurements"), load(spark, d, "layers")
    files = load(spark, d, "silhouette_files")
    ref = lambda name: F.lit(name).alias("ref_field")
    month = lambda c: F.date_format(c, "yyyy-MM").alias("ref_month")
    big = lambda c: F.col(c).cast("bigint").alias(c)

    flat = nested.flatten(files.filter(F.col("kind").isin("layer", "feud")))
    when = files.select("file_id", "written_at", "deleted_at").groupBy("file_id").agg(F.min("written_at").alias("written_at"), F.max("deleted_at").alias("deleted_at"))
    feeds = files.filter("kind = 'feed'").select("file_id", "stack", "written_at", F.from_json("body", "layer_ids array<string>").alias("b"))

    refs = [
        cells.filter("segment_id is not null and segment_id <> 0").select(ref("cell_measurements.segment_id"), "stack", big("layer"), F.col("segment_id").cast("bigint").alias("ref_id"), F.col("cell_id").alias("row_key"), month("measured_at")),
        nested.contour_rows(flat, "feud").join(when, "file_id").filter("contour_id is not null").select(ref("feud.id"), "stack", F.col("layer_id").alias("layer"), F.col("contour_id").alias("ref_id"), F.col("file_id").alias("row_key"), month("written_at")),
        feeds.select("file_id", "stack", "written_at", F.explode("b.layer_ids").alias("i")).withColumn("i", number(F.col("i"))).filter("i is not null").select(ref("feed.layer_ids"), "stack", F.col("i").alias("layer"), F.col("i").alias("ref_id"), F.col("file_id").alias("row_key"), month("written_at")),
    ]
    live = when.filter("deleted_at is null").select("file_id")
    contours = nested.contour_rows(flat, "layer").join(live, "file_id", "left_semi")
    ids = nested.objects(flat, "").select("hi", "lo", number(nested.scalar("id")).alias("layer"))
    documents = flat.roots.filter("kind = 'layer'").join(live, "file_id", "left_semi").join(ids, ["hi", "lo"])
    targets = [
        layers.filter("deleted_at is null").select(ref("cell_measurements.segment_id"), "stack", big("layer"), F.explode(F.col("label_ids").cast("array<bigint>")).alias("ref_id")),
        contours.select(ref("feud.id"), "stack", F.col("layer_id").alias("layer"), F.col("contour_id").alias("ref_id")),
        documents.select(ref("feed.layer_ids"), "stack", "layer", F.col("layer").alias("ref_id")),
    ]
    together = lambda parts: reduce(DataFrame.unionByName, parts)
    return orphan_references(refs[0].unionByName(cut(together(refs[1:]), "refs")), targets[0].unionByName(cut(together(targets[1:]), "targets")), KEY, "ref_month")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _references(spark, d).rows
    return rows.select("ref_field", "row_key", F.col("layer").cast("int").alias("layer"), "ref_id", "ref_month").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    counts = _references(spark, d).counts
    return counts.groupBy("ref_field", "ref_month").agg(F.count("*").alias("orphan_keys"), F.sum("n_refs").alias("orphan_refs"))


def p6_stacks(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose stack and layer have no live load at all: keys of many references each, nearly all of them heavy."""
    cells = load(spark, d, "cell_measurements").select("stack", "layer", F.date_format("measured_at", "yyyy-MM").alias("ref_month"))
    loaded = load(spark, d, "layers").filter("deleted_at is null").select("stack", "layer")
    return orphan_references(cells, loaded, ["stack", "layer"], "ref_month").counts.select("stack", "layer", "ref_month", "n_refs")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_records, p2_compacted, p3_found, p3_changes, p3_schema, p3_unified, p5_found, p5_members, p5_bridges, p6_found, p6_report, p6_stacks)}
NUMBER = "TRY_CAST(TRY_CAST({} AS DOUBLE) AS BIGINT)"
TEXT = "json_extract_string({}, '$.{}')"


def _id(of: str, name: str = "id") -> str:
    return NUMBER.format(TEXT.format(of, name))


RECORDS = f"""f AS (SELECT DISTINCT file_id, path, written_at, content FROM segment_files),
l AS (SELECT file_id, written_at, split_part(path, '/', 1) AS stack, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM f),
o AS (SELECT * FROM l WHERE CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END),
r AS (SELECT file_id, line_no, stack, line, row_number() OVER (PARTITION BY stack, {_id("line", "layer")}, {_id("line", "segment_id")} ORDER BY written_at, file_id, line_no) AS n FROM o)"""

DOCUMENTS = f"""f AS (SELECT DISTINCT file_id, stack, kind, written_at, deleted_at, body FROM silhouette_files),
layer_documents AS (SELECT file_id, stack, deleted_at, {_id("body")} AS layer, body FROM f WHERE kind = 'layer'),
layer_contours AS (SELECT file_id, stack, deleted_at, layer, c, {_id("c")} AS id FROM (SELECT *, unnest(json_extract(body, '$.contours[*]')) AS c FROM layer_documents)),
feud_layers AS (SELECT file_id, stack, written_at, unnest(json_extract(body, '$.layers[*]')) AS l FROM f WHERE kind = 'feud'),
feud_contours AS (SELECT file_id, stack, written_at, {_id("l")} AS layer, c, {_id("c")} AS id FROM (SELECT *, unnest(json_extract(l, '$.contours[*]')) AS c FROM feud_layers))"""

KIND = "CASE json_type({0}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN NULL ELSE 'number' END"
SORTED = """CASE WHEN json_type({0}) = 'OBJECT' THEN '{{' || coalesce(list_aggregate(list_transform(list_sort(json_keys({0})), lambda k: '"' || k || '":' || json_extract({0}, '$."' || k || '"')), 'string_agg', ','), '') || '}}' ELSE json_extract_string({0}, '$') END"""
MEMBER = """json_extract({}, '$."' || k || '"')"""

CHANGES = f"""params AS (SELECT file_id, k, {MEMBER.format("p")} AS v FROM (SELECT file_id, json_extract(body, '$.params') AS p, unnest(json_keys(json_extract(body, '$.params'))) AS k FROM f WHERE kind = 'metadata')),
avg AS (SELECT file_id, json_extract(c, '$.color_avg') AS a FROM layer_contours),
named AS (SELECT file_id, a, k, {MEMBER.format("a")} AS v FROM (SELECT file_id, a, unnest(json_keys(a)) AS k FROM avg WHERE json_type(a) = 'OBJECT')
 UNION ALL SELECT file_id, a, json_extract_string(e, '$.channel'), json_extract(e, '$.value') FROM (SELECT file_id, a, unnest(json_extract(a, '$[*]')) AS e FROM avg WHERE json_type(a) = 'ARRAY')),
h AS (SELECT file_id, field, min(type) AS type FROM (SELECT file_id, 'params.' || k AS field, {KIND.format("v")} AS type FROM params UNION ALL SELECT file_id, 'color_avg.' || k, {KIND.format("v")} FROM named
 UNION ALL SELECT file_id, 'color_avg', {KIND.format("a")} FROM named WHERE json_type(v) <> 'NULL') WHERE type IS NOT NULL GROUP BY ALL),
s AS (SELECT file_id, lag(file_id) OVER (PARTITION BY stack, kind ORDER BY written_at, file_id) AS before FROM f WHERE kind = 'metadata' OR (kind = 'layer' AND file_id IN (SELECT file_id FROM h))),
c AS (SELECT file_id, field, type FROM s JOIN h USING (file_id) WHERE before IS NOT NULL), b AS (SELECT s.file_id, field, type FROM s JOIN h ON h.file_id = s.before),
j AS (SELECT coalesce(c.file_id, b.file_id) AS file_id, coalesce(c.field, b.field) AS field, c.type AS ct, b.type AS bt FROM c FULL JOIN b ON c.file_id = b.file_id AND c.field = b.field),
n AS (SELECT file_id, count(*) FILTER (ct IS NULL) = 1 AND count(*) FILTER (bt IS NULL) = 1 AS renamed, min(bt) FILTER (ct IS NULL) AS gone FROM j GROUP BY file_id),
hs AS (SELECT DISTINCT h.file_id, f.stack, f.kind, h.field, h.type FROM h JOIN f USING (file_id)),
schema AS (SELECT kind, field, CASE WHEN count(DISTINCT type) = 1 THEN min(type) WHEN bool_and(type IN ('number', 'boolean')) THEN 'number' ELSE 'string' END AS union_type, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(DISTINCT file_id) AS n_files, min(file_id) AS first_file, max(file_id) AS last_file FROM hs GROUP BY kind, field)"""

SQL: dict[str, str] = {
    "p3_found": f"WITH {DOCUMENTS}, {CHANGES} SELECT file_id, field, CASE WHEN ct <> bt THEN 'retyped' WHEN renamed THEN 'renamed' WHEN ct IS NULL THEN 'removed' ELSE 'added' END AS change_kind FROM j JOIN n USING (file_id) WHERE ct <> bt OR bt IS NULL OR (ct IS NULL AND NOT renamed)",
    "p2_compacted": "SELECT file_id, path, stack, size_bytes, length(content) AS n_chars FROM segment_files",
    "p2_records": f"""WITH {RECORDS}, m AS (SELECT split_part(path, '/', 1) AS stack, TRY_CAST(CASE WHEN json_valid(metadata) THEN {TEXT.format("metadata", "depth")} END AS DOUBLE) AS depth FROM segment_files),
d AS (SELECT stack, max(CASE WHEN depth = floor(depth) THEN depth::BIGINT END) AS depth FROM m GROUP BY stack)
SELECT stack, {_id("line", "layer")} AS layer, {_id("line", "segment_id")} AS segment_id, d.depth, file_id, line_no::INT AS line_no, trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS record FROM r LEFT JOIN d USING (stack) WHERE n = 1""",
    "p3_changes": f"""WITH {DOCUMENTS}, {CHANGES}, x AS (SELECT file_id, field, CASE WHEN ct <> bt THEN 'retyped' WHEN renamed THEN 'renamed' WHEN ct IS NULL THEN 'removed' ELSE 'added' END AS change_kind, CASE WHEN renamed AND bt IS NULL THEN gone ELSE bt END AS type_before, ct AS type
 FROM j JOIN n USING (file_id) WHERE ct <> bt OR bt IS NULL OR (ct IS NULL AND NOT renamed)) SELECT x.*, f.stack, f.kind, union_type FROM x JOIN (SELECT DISTINCT file_id, stack, kind FROM f) f USING (file_id) JOIN schema USING (kind, field)""",
    "p3_schema": f"WITH {DOCUMENTS}, {CHANGES} SELECT kind, field, union_type, CASE union_type WHEN 'number' THEN 'double' WHEN 'object' THEN 'variant' WHEN 'array' THEN 'variant' ELSE union_type END AS stored_as, types, n_files, first_file, last_file FROM schema",
    "p3_unified": f"""WITH {DOCUMENTS}, {CHANGES}, by_contour AS (SELECT file_id, id, row_number() OVER () AS pos, json_extract(c, '$.color_avg') AS a FROM layer_contours),
named_by AS (SELECT file_id, id, pos, k, {MEMBER.format("a")} AS v FROM (SELECT file_id, id, pos, a, unnest(json_keys(a)) AS k FROM by_contour WHERE json_type(a) = 'OBJECT')
 UNION ALL SELECT file_id, id, pos, json_extract_string(e, '$.channel'), json_extract(e, '$.value') FROM (SELECT file_id, id, pos, unnest(json_extract(a, '$[*]')) AS e FROM by_contour WHERE json_type(a) = 'ARRAY')),
all_values AS (SELECT DISTINCT file_id, 'metadata' AS kind, NULL::BIGINT AS contour_id, 0 AS pos, 'params.' || k AS field, v FROM params UNION ALL SELECT DISTINCT file_id, 'layer', id, pos, 'color_avg.' || k, v FROM named_by)
SELECT file_id, kind, contour_id, field, union_type, CASE WHEN union_type = 'number' THEN coalesce(TRY_CAST(json_extract_string(v, '$') AS DOUBLE), CASE json_extract_string(v, '$') WHEN 'true' THEN 1 WHEN 'false' THEN 0 END) END AS number_value,
 CASE WHEN union_type = 'boolean' THEN json_extract_string(v, '$') = 'true' END AS boolean_value, CASE WHEN union_type IN ('string', 'object', 'array') THEN {SORTED.format("v")} END AS text_value FROM all_values JOIN schema USING (kind, field) WHERE json_type(v) <> 'NULL'""",
    "p2_found": f"WITH {RECORDS} SELECT file_id, line_no::INT AS line_no FROM r WHERE n > 1",
    "p5_found": f"""WITH {DOCUMENTS}, m AS (SELECT file_id, layer, id, unnest(['color_avg', 'color_std']) AS s, unnest([json_extract(c, '$.color_avg'), json_extract(c, '$.color_std')]) AS v FROM layer_contours),
by_name AS (SELECT file_id, layer, id, s, unnest(json_keys(v)) AS k, v FROM m WHERE json_type(v) = 'OBJECT'), entries AS (SELECT file_id, layer, id, s, unnest(json_extract(v, '$[*]')) AS e FROM m WHERE json_type(v) = 'ARRAY')
SELECT DISTINCT file_id, layer::INT AS layer_id, id::INT AS contour_id, s || '.' || k AS leaf FROM by_name WHERE json_type(json_extract(v, '$."' || k || '"')) <> 'NULL'
UNION SELECT file_id, layer::INT, id::INT, s || '.' || json_extract_string(e, '$.channel') FROM entries WHERE json_type(json_extract(e, '$.value')) <> 'NULL'
UNION SELECT file_id, layer::INT, id::INT, 'label' FROM feud_contours WHERE trim(json_extract_string(c, '$.label')) <> ''""",
    "p6_found": f"""WITH {DOCUMENTS}, s AS (SELECT DISTINCT stack, layer, unnest(label_ids) AS id FROM layers WHERE deleted_at IS NULL),
feeds AS (SELECT file_id, stack, written_at, {NUMBER.format("json_extract_string(i, '$')")} AS id FROM (SELECT *, unnest(json_extract(body, '$.layer_ids[*]')) AS i FROM f WHERE kind = 'feed'))
SELECT DISTINCT 'cell_measurements.segment_id' AS ref_field, cell_id AS row_key, layer, segment_id::BIGINT AS ref_id, strftime(measured_at, '%Y-%m') AS ref_month FROM cell_measurements c
 WHERE segment_id <> 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.stack = c.stack AND s.layer = c.layer AND s.id = c.segment_id)
UNION SELECT 'feud.id', file_id, layer::INT, id, strftime(written_at, '%Y-%m') FROM feud_contours q WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM layer_contours t WHERE t.deleted_at IS NULL AND t.stack = q.stack AND t.layer = q.layer AND t.id = q.id)
UNION SELECT 'feed.layer_ids', file_id, id::INT, id, strftime(written_at, '%Y-%m') FROM feeds q WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM layer_documents t WHERE t.deleted_at IS NULL AND t.stack = q.stack AND t.layer = q.id)""",
    "p6_report": f"""WITH {DOCUMENTS}, s AS (SELECT DISTINCT stack, layer, unnest(label_ids) AS id FROM layers WHERE deleted_at IS NULL),
feeds AS (SELECT file_id, stack, written_at, {NUMBER.format("json_extract_string(i, '$')")} AS id FROM (SELECT *, unnest(json_extract(body, '$.layer_ids[*]')) AS i FROM f WHERE kind = 'feed')), o AS (SELECT 'cell_measurements.segment_id' AS ref_field, stack, layer, segment_id::BIGINT AS ref_id, strftime(measured_at, '%Y-%m') AS ref_month FROM cell_measurements c
 WHERE segment_id <> 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.stack = c.stack AND s.layer = c.layer AND s.id = c.segment_id)
UNION ALL SELECT 'feud.id', stack, layer, id, strftime(written_at, '%Y-%m') FROM feud_contours q WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM layer_contours t WHERE t.deleted_at IS NULL AND t.stack = q.stack AND t.layer = q.layer AND t.id = q.id)
UNION ALL SELECT 'feed.layer_ids', stack, id, id, strftime(written_at, '%Y-%m') FROM feeds q WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM layer_documents t WHERE t.deleted_at IS NULL AND t.stack = q.stack AND t.layer = q.id))
SELECT ref_field, ref_month, count(DISTINCT row(stack, layer, ref_id)) AS orphan_keys, count(*) AS orphan_refs FROM o GROUP BY ALL""",
    "p6_stacks": "SELECT stack, layer, strftime(measured_at, '%Y-%m') AS ref_month, count(*) AS n_refs FROM cell_measurements c WHERE NOT EXISTS (SELECT 1 FROM layers l WHERE l.deleted_at IS NULL AND l.stack = c.stack AND l.layer = c.layer) GROUP BY ALL",
}
