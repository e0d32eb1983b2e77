"""Contour documents: labels and measurements from nested JSON, and back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.json import number

FEUD = "layers array<struct<id: string, contours: array<struct<id: string, label: string>>>>"
CONTOURS = "id string, contours array<struct<id: string, centroid: array<double>, pixel_count: bigint, color_avg: map<string, string>, color_std: map<string, string>>>"


def read_labels(files: DataFrame) -> DataFrame:
    """stack, layer, segment_id, label of contours with a label that is neither null nor blank, of live feud documents.

    A contour labelled in several documents of a stack takes the label of the one written last.
    """
    live = files.filter("kind = 'feud' and deleted_at is null").select("file_id", "stack", "written_at", F.from_json("body", FEUD).alias("b"))
    layers = live.select("file_id", "stack", "written_at", F.explode("b.layers").alias("l"))
    rows = layers.select("file_id", "stack", "written_at", number(F.col("l.id")).alias("layer"), F.explode("l.contours").alias("c"))
    named = rows.select("file_id", "stack", "written_at", "layer", number(F.col("c.id")).alias("segment_id"), F.trim("c.label").alias("label")).filter("label <> ''")
    return named.groupBy("stack", "layer", "segment_id").agg(F.max_by("label", F.struct("written_at", "file_id", "label")).alias("label"))


def _other_than(name: str):
    return lambda key, _: key != name


def read_contours(files: DataFrame) -> DataFrame:
    """Measurements of the contours of live layer documents whose colours are objects of numbers: stack, file_id, layer, segment_id, centroid_x, centroid_y, pixel_count, colors.

    colors is a map of channel to number; r, g and b are dropped where ch0, ch1 and ch2 exist. Colours of
    other shapes are null here; the nested-record operator keeps them.
    """
    live = files.filter("kind = 'layer' and deleted_at is null").select("file_id", "stack", F.from_json("body", CONTOURS).alias("b"))
    once = live.dropDuplicates(["file_id"])
    rows = once.select("file_id", "stack", number(F.col("b.id")).alias("layer"), F.explode("b.contours").alias("c"))
    colors = F.transform_values("c.color_avg", lambda _, v: v.try_cast("double"))
    for short, channel in (("r", "ch0"), ("g", "ch1"), ("b", "ch2")):
        replaced = F.coalesce(F.map_contains_key("c.color_avg", channel), F.lit(False))
        colors = F.when(replaced, F.map_filter(colors, _other_than(short))).otherwise(colors)
    return rows.select("stack", "file_id", "layer", number(F.col("c.id")).alias("segment_id"), F.get("c.centroid", F.lit(0)).alias("centroid_x"), F.get("c.centroid", F.lit(1)).alias("centroid_y"), "c.pixel_count", colors.alias("colors"))


def build_feud(labels: DataFrame, keys: list[str]) -> DataFrame:
    """A feud document per group of keys: JSON of layers, each with its contours' ids and labels in order. A layer's contours are an image's."""
    layers = labels.groupBy(*keys, "layer").agg(F.sort_array(F.collect_list(F.struct(F.col("segment_id").alias("id"), "label"))).alias("contours"))
    return layers.groupBy(*keys).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(F.col("layer").alias("id"), "contours"))).alias("layers"))).alias("body"))


def convex_hulls(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Convex hull of each segment's pixels as points (x, y); segments whose pixels lie on one line have none.

    Only the outermost pixels of each row reach a group: at most two a row.
    """
    types = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys)
    rims = pixels.groupBy(*keys, "row").agg(F.min("col").alias("first"), F.max("col").alias("last"))

    def hull(group: pd.DataFrame) -> pd.DataFrame:
        points = sorted({(float(c), float(r)) for r, a, b in zip(group["row"], group["first"], group["last"], strict=True) for c in (a, b)})
        half = []
        for ordered in (points, points[::-1]):
            chain: list[tuple[float, float]] = []
            for p in ordered:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                    chain.pop()
                chain.append(p)
            half += chain[:-1]
        rows = [{k: group[k].iloc[0] for k in keys} | {"points": [list(p) for p in half]}] if len(half) > 2 else []
        return pd.DataFrame(rows, columns=[*keys, "points"])

    return rims.groupBy(*keys).applyInPandas(hull, f"{types}, points array<array<double>>")


def build_contours(measured: DataFrame, hulls: DataFrame, keys: list[str], channels: dict[str, str]) -> DataFrame:
    """Contour objects: measurements with a hull, their points, and colours r, g and b from the channels (0.0 where missing)."""
    color = lambda suffix: F.create_map(*[x for c in "rgb" for x in (F.lit(c), F.coalesce(F.col(channels[c] + suffix), F.lit(0.0)) if c in channels else F.lit(0.0))])
    return measured.join(hulls, keys).select(*keys, F.array("centroid_x", "centroid_y").alias("centroid"), "pixel_count", "points", color("").alias("color_avg"), color("_std").alias("color_std"))
