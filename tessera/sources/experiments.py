"""Experiments as partitioned tables: one folder per stack and layer, found and pruned by Spark."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.measure import LAYER, overflowing


def write_measurements(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write measurements, pixels or processed data as path/stack=.../layer=.... Rows of a layer go to few files."""
    df.repartition(*LAYER).write.mode(mode).partitionBy(*LAYER).parquet(path)


def read_measurements(spark: SparkSession, path: str, stack: str | None = None, layer: int | None = None) -> DataFrame:
    """Read what :func:`write_measurements` wrote; a stack or layer given prunes partitions."""
    df = spark.read.parquet(path)
    df = df if stack is None else df.filter(F.col("stack") == stack)
    return df if layer is None else df.filter(F.col("layer") == layer)


def stacks(spark: SparkSession, path: str) -> DataFrame:
    """Stacks of an experiment with their number of layers."""
    return spark.read.parquet(path).groupBy("stack").agg(F.count_distinct("layer").alias("layers"))


def initialise(pixels: DataFrame, channels: list[str], bits: int) -> DataFrame:
    """Metadata of each stack (bits, depth, colordepth) after checking that no pixel exceeds 2 ** bits; an error names a layer that does."""
    bad = overflowing(pixels, channels, bits).limit(1).collect()
    if bad:
        raise ValueError(f"stack {bad[0]['stack']}, layer {bad[0]['layer']}: {bad[0]['top']} exceeds {bits} bits")
    return pixels.groupBy("stack").agg(F.lit(bits).alias("bits"), F.count_distinct("layer").alias("depth"), F.lit(len(channels)).alias("colordepth"))


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents under a given schema; a document that does not fit gives nulls."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


_TYPES = {1: "B", 3: "H", 4: "I"}


def _tiff_pages(data: bytes) -> list[np.ndarray]:
    """Pages of an uncompressed grey-scale TIFF of 8 or 16 bits, by its directory entries."""
    order = "<" if data[:2] == b"II" else ">"
    at, pages = struct.unpack(order + "I", data[4:8])[0], []
    while at:
        entries = {}
        for e in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            tag, kind, count, value = struct.unpack(order + "HHI4s", data[at + 2 + 12 * e : at + 14 + 12 * e])
            code = _TYPES.get(kind)
            if code:
                size = struct.calcsize(code) * count
                raw = value[:size] if size <= 4 else data[(o := struct.unpack(order + "I", value)[0]) : o + size]
                entries[tag] = struct.unpack(f"{order}{count}{code}", raw)
        if entries.get(259, (1,))[0] != 1:
            raise ValueError("compressed TIFF files are not read")
        strips = b"".join(data[o : o + n] for o, n in zip(entries[273], entries[279], strict=True))
        kind = np.dtype(f"{order}u{entries.get(258, (8,))[0] // 8}")
        pages.append(np.frombuffer(strips, kind, count=entries[256][0] * entries[257][0]).reshape(entries[257][0], entries[256][0]))
        at = struct.unpack(order + "I", data[at + 2 + 12 * struct.unpack(order + "H", data[at : at + 2])[0] :][:4])[0]
    return pages


def read_images(spark: SparkSession, path: str, channels: int = 1, bits: int = 12) -> DataFrame:
    """Pixels of images: stack (file name), layer, row, col, ch0...; values over 2 ** bits.

    Reads uncompressed TIFF files, whose pages are layers with ``channels`` pages each, and .npy arrays of
    layer x row x column (x channel). A 3-D array has one channel; of a 4-D array the smallest of the last
    three axes is the channel. Files are read by the tasks that need them.
    """

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content)
                cube = np.load(io.BytesIO(data), allow_pickle=False) if name.endswith(".npy") else np.stack(_tiff_pages(data))
                if name.endswith(".npy"):
                    cube = cube[None] if cube.ndim == 2 else cube
                    cube = cube[..., None] if cube.ndim == 3 else np.moveaxis(cube, 1 + int(np.argmin(cube.shape[1:])), -1)
                else:
                    cube = np.moveaxis(cube.reshape(-1, channels, *cube.shape[1:]), 1, -1)
                for k, layer in enumerate(cube):
                    r, c = np.indices(layer.shape[:2])
                    yield pd.DataFrame({"stack": name.rpartition("/")[2].rpartition(".")[0], "layer": k, "row": r.ravel(), "col": c.ravel()} | {f"ch{i}": layer[..., i].ravel() / float(1 << bits) for i in range(channels)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "stack string, layer int, row int, col int, " + ", ".join(f"ch{i} double" for i in range(channels)))


def import_labels(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Adopt a label mask (stack, layer, row, col, label); pixels without one are background. Negative or fractional labels are an error."""
    if labels.schema["label"].dataType.simpleString() not in ("int", "bigint", "smallint"):
        raise TypeError("labels must be whole numbers")
    if labels.filter("label < 0").limit(1).count():
        raise ValueError("labels must not be negative")
    return pixels.drop("label").join(labels.select(*LAYER, "row", "col", "label"), [*LAYER, "row", "col"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
