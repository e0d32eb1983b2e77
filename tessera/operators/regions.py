"""Regions: polygons, containment, concurrency of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inside(x: Column, y: Column, vertices: Column) -> Column:
    """Whether a point is inside a polygon (array of structs x, y) by counting crossings; points on an edge are undefined.

    False for polygons of fewer than three vertices, null for a null polygon.
    """
    n = F.size(vertices)
    edges = F.transform(vertices, lambda v, i: F.struct(v["x"].alias("x1"), v["y"].alias("y1"), F.element_at(vertices, ((i + 1) % n + 1).cast("int"))["x"].alias("x2"), F.element_at(vertices, ((i + 1) % n + 1).cast("int"))["y"].alias("y2")))
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.when(vertices.isNotNull(), (n >= 3) & (F.aggregate(edges, F.lit(0), lambda k, e: k + F.when(crosses(e), 1).otherwise(0)) % 2 == 1))


def select_region(cells: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Set ``selected``: inside the polygon of the layer's region if that is included, else false."""
    joined = cells.drop("selected").join(regions.select(*keys, "include", "vertices"), keys, "left")
    return joined.withColumn("selected", F.coalesce(F.col("include") & inside(F.col("x"), F.col("y"), F.col("vertices")), F.lit(False))).drop("include", "vertices")


def mask_vertices(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Border of a mask (keys, row, col of its pixels) as one polygon per group, in order of angle about its mean.

    A border pixel lacks one of its eight neighbours. Right for star-shaped regions only. The border of a
    region is gathered, not the region.
    """
    rounds = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    near = mask.select(*keys, "row", "col").distinct().withColumn("_o", F.explode(rounds)).groupBy(*keys, (F.col("row") + F.col("_o.r")).alias("row"), (F.col("col") + F.col("_o.c")).alias("col"))
    counts = near.agg(F.count("*").alias("_n"), F.max(((F.col("_o.r") == 0) & (F.col("_o.c") == 0)).cast("int")).alias("_in"))
    border = counts.filter("_in = 1 and _n < 9")
    means = border.groupBy(*keys).agg(F.avg("row").alias("_r"), F.avg("col").alias("_c"))
    turned = border.join(means, keys).withColumn("_a", F.atan2(F.col("row") - F.col("_r"), F.col("col") - F.col("_c")))
    listed = turned.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_a", "col", "row"))).alias("_v"))
    return listed.select(*keys, F.transform("_v", lambda v: F.struct(v["col"].cast("double").alias("x"), v["row"].cast("double").alias("y"))).alias("vertices"))


def concurrency(cells: DataFrame, keys: list[str], label: str, values: list, x: str = "x", most: float = 10.0, population: int = 5) -> DataFrame:
    """Add ``concurrent_{value}`` for each label value: whether the nearest cell of that label is within ``most`` along x.

    Only groups with more than ``population`` cells of the label count. A cell is at distance 0 from
    itself. Two running frames per label replace a join: the last such x before and the first after. A
    null x or label is never near and never a target.
    """
    whole = Window.partitionBy(*keys)
    before, after = whole.orderBy(F.col(x).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0), whole.orderBy(F.col(x).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)
    for value in values:
        at = F.when(F.col(label) == value, F.col(x))
        gap = F.least(F.col(x) - F.max(at).over(before), F.min(at).over(after) - F.col(x))
        cells = cells.withColumn(f"concurrent_{value}", F.coalesce((F.count(at).over(whole) > population) & (gap <= most), F.lit(False)))
    return cells


def group_means(cells: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Mean of each attribute per group; nulls do not count."""
    return cells.groupBy(*keys).agg(*[F.avg(a).alias(a) for a in attributes])


def label_distribution(cells: DataFrame, label: str) -> DataFrame:
    """Number and share of each label; null is a label."""
    return cells.groupBy(label).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def majority(votes: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most frequent label per group, ties to the least; null is no vote."""
    counts = votes.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("_n", (-F.col(label)).alias("l"))).alias(label))
