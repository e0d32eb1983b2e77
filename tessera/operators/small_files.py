"""Many tiny files of records into few well-sized ones."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.json import bound, number, stripped, with_object
from tessera.session import scratch, settings


@dataclass(frozen=True)
class Packed:
    """A verified table at ``path`` and what was checked."""

    path: str
    rows: int
    checksum: int
    files: int  # at most


def _bytes_under(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def _sums(df: DataFrame) -> list:
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("checksum")]


def write_verified(df: DataFrame, path: str, files: int | None = None) -> Packed:
    """Write ``df`` beside ``path``, into at most ``files`` files if given, read them back, compare, then rename.

    Partitions are joined without a shuffle to get down to ``files``. The number of rows and an order-free checksum over all columns are taken while writing and again
    from the written files. ``path`` appears only if both agree; otherwise an error names the staging
    folder, which is kept.
    """
    spark = df.sparkSession
    staging, seen = f"{path}.staging", Observation()
    (df if files is None else df.coalesce(files)).observe(seen, *_sums(df)).write.mode("overwrite").parquet(staging)
    back = spark.read.schema(df.schema).parquet(staging)
    got, want = back.agg(*_sums(back)).first(), seen.get
    if (got["rows"], got["checksum"]) != (want["rows"], want["checksum"]):
        raise RuntimeError(f"{staging} holds {got['rows']} rows, {want['rows']} were written, or contents differ")
    jvm = spark.sparkContext._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, to):
        raise RuntimeError(f"{staging} can't be renamed to {path}")
    return Packed(path, int(got["rows"]), int(got["checksum"]), len(back.inputFiles()) if files is None else files)


def packed_read(spark: SparkSession, split_bytes: int, open_cost: int):
    """Settings under which a scan packs many small files into one split of about ``split_bytes``.

    Each file counts ``open_cost`` bytes more than it has, so a split holds at most
    ``split_bytes / open_cost`` files, however small they are.
    """
    return settings(spark, spark__sql__files__maxPartitionBytes=split_bytes, spark__sql__files__openCostInBytes=open_cost, spark__sql__files__minPartitionNum=1)


def compact_folder(spark: SparkSession, source: str, target: str, fmt: str = "parquet", target_bytes: int = 128 << 20, open_cost: int = 1 << 20) -> Packed:
    """Rewrite all files of ``source`` as Parquet files of about ``target_bytes`` at ``target``.

    The scan packs small files into splits of ``target_bytes``, and each split is written by the task
    that read it: nothing is shuffled. A file larger than a split is cut where its format allows. Null,
    empty and repeated records are kept as they are; an empty source gives an empty table.
    """
    with packed_read(spark, target_bytes, open_cost):
        df = spark.read.format(fmt).load(source)
        return write_verified(df, target, max(1, math.ceil(_bytes_under(spark, source) / target_bytes)))


def records(files: DataFrame) -> DataFrame:
    """The records of a table of files: one row per line of ``content`` that is a complete JSON object.

    Columns: file_key, file_id, line_no (from 1, blank lines counted), written_at, stack (first piece of
    ``path``), layer and segment_id as whole numbers in whatever spelling, depth (metadata.depth as a
    number, null if missing or no number), record (the line without outer blanks). Null or empty
    content has no record. A null file_id is told apart by its path. Nothing is shuffled.
    """
    own = files.select(
        F.coalesce(F.col("file_id").cast("string"), F.concat(F.lit("path:"), F.col("path"))).alias("file_key"), "file_id", "written_at",
        F.split_part("path", F.lit("/"), F.lit(1)).alias("stack"),
        bound(F.try_variant_get(F.try_parse_json("metadata"), "$.depth", "string"), number).alias("depth"), F.split("content", "\n", -1).alias("_lines"),
    )
    lines = own.select(*[c for c in own.columns if c != "_lines"], F.posexplode_outer("_lines").alias("_pos", "_line"))
    return with_object(lines, "_line", "_v").select(
        "file_key", "file_id", (F.col("_pos") + 1).alias("line_no"), "written_at", "stack",
        number(F.try_variant_get("_v", "$.layer", "string")).alias("layer"),
        number(F.try_variant_get("_v", "$.segment_id", "string")).alias("segment_id"),
        "depth", stripped(F.col("_line")).alias("record"),
    )


@dataclass(frozen=True)
class Consolidated:
    """``staged``: every record of every listing of a file; ``kept``: each record once, at its first occurrence."""

    staged: DataFrame
    kept: DataFrame
    packed: Packed


def consolidate(spark: SparkSession, source: str, target_bytes: int = 128 << 20, open_cost: int = 1 << 20, split_bytes: int = 32 << 20) -> Consolidated:
    """Consolidate the records of a table of tiny files, each record exactly once, into few files.

    The table is read in splits of at most ``split_bytes``, parsed where it is read, and the occurrences are
    staged and verified against what was parsed: nothing is shuffled. The first occurrence of each record, by
    (written_at, file_id, line_no), comes from a minimum that combines before its shuffle, so a record or
    file repeated any number of times makes no large group. What is kept is written by all tasks and then
    compacted to files of ``target_bytes`` by :func:`compact_folder`: packed splits, no shuffle, staged, verified and
    renamed.

    A file listed twice is one file (if its listings differ, the least line counts). A missing written_at
    comes first. Records without layer or segment_id cannot be told apart and are all kept. depth is the
    stack's largest known metadata.depth. Other columns are not read. An empty source gives empty tables.
    """
    with settings(spark, spark__sql__files__maxPartitionBytes=split_bytes, spark__sql__files__openCostInBytes=256 << 10):
        parsed = records(spark.read.parquet(source))
        staged = write_verified(parsed, scratch(spark, "occurrences"))
    raw = spark.read.schema(parsed.schema).parquet(staged.path)
    first = F.min(F.struct("written_at", "file_id", "file_key", "line_no", "layer", "segment_id", "record")).alias("o")
    known = F.col("layer").isNotNull() & F.col("segment_id").isNotNull()
    firsts = raw.filter(known).groupBy("stack", F.col("layer").alias("_l"), F.col("segment_id").alias("_s")).agg(first).select("stack", "o.*")
    unnamed = raw.filter(~known).groupBy("stack", F.col("file_key").alias("_f"), F.col("line_no").alias("_n")).agg(first).select("stack", "o.*")
    depths = raw.groupBy("stack").agg(F.max("depth").alias("depth"))
    kept = firsts.unionByName(unnamed).alias("f").join(depths.alias("d"), F.col("f.stack").eqNullSafe(F.col("d.stack")), "left").select("f.*", "d.depth")
    loose = scratch(spark, "kept")
    kept.write.parquet(loose)
    packed = compact_folder(spark, loose, scratch(spark, "records"), target_bytes=target_bytes, open_cost=open_cost)
    return Consolidated(raw, spark.read.schema(kept.schema).parquet(packed.path), packed)


def repeated(done: Consolidated) -> DataFrame:
    """Occurrences of a record that has occurred before, once each: all but those kept. Columns as in :func:`records`, without the record."""
    rest = done.staged.drop("record").join(done.kept.select("file_key", "line_no"), ["file_key", "line_no"], "left_anti")
    return rest.dropDuplicates(["file_key", "line_no"])
