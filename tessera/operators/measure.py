"""Pixels to measurements, and column operators on measurements."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAYER = ["stack", "layer"]


def unit_pixels(pixels: DataFrame, channels: list[str], bits: int = 12) -> DataFrame:
    """Raw values divided by 2 ** bits."""
    return pixels.withColumns({c: F.col(c) / float(1 << bits) for c in channels})


def overflowing(pixels: DataFrame, channels: list[str], bits: int) -> DataFrame:
    """Layers whose pixels exceed 2 ** bits in any channel, with the maximum; none if the bit depth holds."""
    tops = pixels.groupBy(*LAYER).agg(F.array_max(F.array(*[F.max(c) for c in channels])).alias("top"))
    return tops.filter(F.col("top") > float(1 << bits))


def reorder_channels(pixels: DataFrame, order: list[int]) -> DataFrame:
    """Channel k of the result is channel ``order[k]`` of the input."""
    rest = [c for c in pixels.columns if not (c.startswith("ch") and c[2:].isdigit())]
    return pixels.select(*rest, *[F.col(f"ch{o}").alias(f"ch{k}") for k, o in enumerate(order)])


def to_rgb(pixels: DataFrame, channels: dict[str, str]) -> DataFrame:
    """Columns r, g and b from the channels they are mapped to; colours without a channel are 0."""
    return pixels.withColumns({c: F.coalesce(F.col(channels[c]), F.lit(0.0)) if c in channels else F.lit(0.0) for c in "rgb"})


def measure_segments(pixels: DataFrame, keys: list[str], channels: list[str], label: str = "label") -> DataFrame:
    """One row per segment: centroid (x is the column, y the row), pixel count, and mean and population deviation per channel.

    Pixels of label 0 or null are background. One aggregate, combined before its only shuffle. Null channel
    values do not count; a segment without any has null.
    """
    stats = [s for c in channels for s in (F.avg(c).alias(c), F.stddev_pop(c).alias(f"{c}_std"))]
    measured = pixels.filter(F.col(label) != 0).groupBy(*keys, label).agg(F.avg("col").alias("centroid_x"), F.avg("row").alias("centroid_y"), F.count("*").alias("pixel_count"), *stats)
    return measured.withColumnRenamed(label, "segment_id")


def normalise(measured: DataFrame, background: str, channels: list[str]) -> DataFrame:
    """``{channel}_normalized``: each channel over the background channel; null where that is 0 or null."""
    return measured.withColumns({f"{c}_normalized": F.col(c) / F.nullif(F.col(background), F.lit(0.0)) for c in channels if c != background})


def fit_bleedthrough(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Ordinary least squares y = b + m x per group, over rows where both are neither null nor 0."""
    used = rows.filter((F.col(x) != 0) & (F.col(y) != 0))
    return used.groupBy(*keys).agg(F.regr_intercept(y, x).alias("b"), F.regr_slope(y, x).alias("m"), F.count("*").alias("n"))


def fit_bleedthrough_gamma(rows: DataFrame, x: str, y: str, iterations: int = 50) -> tuple[float, float]:
    """Intercept and slope of a Gamma model with identity link, over rows where both values are positive."""
    data = VectorAssembler(inputCols=[x], outputCol="features").transform(rows.filter((F.col(x) > 0) & (F.col(y) > 0)).select(x, y))
    model = GeneralizedLinearRegression(family="gamma", link="identity", labelCol=y, maxIter=iterations).fit(data)
    return float(model.intercept), float(model.coefficients[0])


def correct_bleedthrough(measured: DataFrame, coefficients: DataFrame, keys: list[str], x: str, y: str, background: str) -> DataFrame:
    """Add {y}_predicted = b + m x, {y}c = y - predicted and {y}c_normalized. Groups without coefficients get nulls."""
    joined = measured.join(coefficients.select(*keys, "b", "m"), keys, "left")
    predicted = F.col("b") + F.col("m") * F.col(x)
    return joined.withColumn(f"{y}_predicted", predicted).withColumn(f"{y}c", F.col(y) - predicted).withColumn(f"{y}c_normalized", (F.col(y) - predicted) / F.nullif(F.col(background), F.lit(0.0))).drop("b", "m")


def resampling_weights(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Probability with which a row is drawn so that x is drawn evenly: the gap to the next distinct x, shared by the rows of an x.

    The largest x has weight 0; groups with a single x have null weights. Rows of null x are dropped.
    """
    counts = rows.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("multiplicity"))
    gap = F.coalesce(F.lead(x).over(Window.partitionBy(*keys).orderBy(x)) - F.col(x), F.lit(0.0))
    gaps = counts.withColumn("gap", gap)
    return gaps.withColumn("weight", F.col("gap") / F.col("multiplicity") / F.nullif(F.sum("gap").over(Window.partitionBy(*keys)), F.lit(0.0)))


def resample(rows: DataFrame, keys: list[str], x: str, size: int) -> DataFrame:
    """Draw ``size`` values of x per group with replacement by :func:`resampling_weights`: the inverse of the cumulated weights at even steps."""
    w = resampling_weights(rows, keys, x).filter("weight > 0").withColumn("share", F.col("weight") * F.col("multiplicity"))
    upto = F.sum("share").over(Window.partitionBy(*keys).orderBy(x))
    steps = w.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("share"))
    draws = steps.withColumn("_from", F.ceil(F.round(F.col("_lo") * size, 6))).withColumn("_to", F.ceil(F.round(F.col("_hi") * size, 6)) - 1).filter(F.col("_to") >= F.col("_from"))
    return draws.withColumn("draw", F.explode(F.sequence("_from", "_to"))).select(*keys, x, "draw")


def drop_small_segments(pixels: DataFrame, keys: list[str], least: int = 10, label: str = "label") -> DataFrame:
    """Set pixels of segments with fewer than ``least`` pixels to background."""
    small = pixels.filter(F.col(label) != 0).groupBy(*keys, label).agg(F.count("*").alias("_n")).filter(F.col("_n") < least).select(*keys, label, F.lit(True).alias("_small"))
    return pixels.join(small, [*keys, label], "left").withColumn(label, F.when(F.col("_small"), F.lit(0).cast(pixels.schema[label].dataType)).otherwise(F.col(label))).drop("_small")


def drop_edge_segments(pixels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Pixels without those of segments that touch the frame (least or largest row or column of the layer)."""
    frame = pixels.groupBy(*keys).agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"))
    on_frame = (F.col("row") == F.col("_r0")) | (F.col("row") == F.col("_r1")) | (F.col("col") == F.col("_c0")) | (F.col("col") == F.col("_c1"))
    touching = pixels.join(frame, keys).filter(on_frame & (F.col(label) != 0)).select(*keys, label).distinct()
    return pixels.join(touching, [*keys, label], "left_anti")


def paint(pixels: DataFrame, measured: DataFrame, keys: list[str], attribute: str, missing: float = -1.0, label: str = "label", interior: str | None = None) -> DataFrame:
    """Give every pixel its segment's ``attribute``; background, unknown segments, and those not in the ``interior`` flag get ``missing``."""
    value = F.col(attribute).cast("double") if interior is None else F.when(F.col(interior), F.col(attribute).cast("double"))
    values = measured.select(*keys, F.col("segment_id").alias(label), value.alias("_v")).filter(F.col(label) != 0)
    return pixels.join(values, [*keys, label], "left").withColumn(f"{attribute}_mask", F.coalesce("_v", F.lit(missing))).drop("_v")


def mean_mask(pixels: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """Add ``mask``: whether the pixel is at least the layer's mean. The mean is a small aggregate joined back."""
    return pixels.join(pixels.groupBy(*keys).agg(F.avg(channel).alias("_mean")), keys, "left").withColumn("mask", F.col(channel) >= F.col("_mean")).drop("_mean")


def otsu_thresholds(pixels: DataFrame, keys: list[str], channel: str, bins: int = 256) -> DataFrame:
    """Otsu threshold per group: the centre of the histogram bin that separates two classes of largest between-class variance.

    The histogram has ``bins`` bins between the group's least and largest value, and at most that many
    rows a group reach the window. A constant group has its value as threshold; ties go to the lowest bin.
    """
    ranges = pixels.groupBy(*keys).agg(F.min(channel).cast("double").alias("_lo"), F.max(channel).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(channel) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = pixels.filter(F.col(channel).isNotNull()).join(ranges, keys).groupBy(*keys, "_lo", "_hi", index.alias("_bin")).agg(F.count("*").alias("_n"))
    centre = F.col("_lo") + (F.col("_bin") + 0.5) * width
    up, whole = Window.partitionBy(*keys).orderBy("_bin"), Window.partitionBy(*keys)
    sums = counts.withColumn("_c", centre).withColumn("_w1", F.sum("_n").over(up)).withColumn("_s1", F.sum(F.col("_n") * F.col("_c")).over(up)).withColumn("_w", F.sum("_n").over(whole)).withColumn("_s", F.sum(F.col("_n") * F.col("_c")).over(whole))
    w2 = F.col("_w") - F.col("_w1")
    between = F.when(w2 > 0, F.round(F.col("_w1") * w2 * F.pow(F.col("_s1") / F.col("_w1") - (F.col("_s") - F.col("_s1")) / F.nullif(w2, F.lit(0)), F.lit(2.0)), 6)).otherwise(-1.0)
    best = sums.withColumn("_v", between).groupBy(*keys).agg(F.max(F.struct("_v", (-F.col("_bin")).alias("b"), "_c")).alias("best"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return best.select(*keys, F.when(F.col("_hi") > F.col("_lo"), F.col("best._c")).otherwise(F.col("_lo")).alias("threshold"))


def otsu_mask(pixels: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """Add ``mask``: whether the pixel is at least its layer's Otsu threshold."""
    return pixels.join(otsu_thresholds(pixels, keys, channel), keys, "left").withColumn("mask", F.col(channel) >= F.col("threshold")).drop("threshold")


def dilated(pixels: DataFrame, keys: list[str], mask: str, steps: int = 1) -> DataFrame:
    """Add ``dilated``: whether a pixel is within ``steps`` rows and columns of a pixel of the mask (8-connected dilation).

    Mask pixels spread by two one-dimensional explodes of 2 * steps + 1 offsets, with duplicates removed between.
    """
    offsets = F.sequence(F.lit(-steps), F.lit(steps))
    rows = pixels.filter(F.col(mask)).select(*keys, "row", "col").withColumn("_o", F.explode(offsets)).select(*keys, (F.col("row") + F.col("_o")).alias("row"), "col").distinct()
    grown = rows.withColumn("_o", F.explode(offsets)).select(*keys, "row", (F.col("col") + F.col("_o")).alias("col")).distinct().withColumn("dilated", F.lit(True))
    return pixels.join(grown, [*keys, "row", "col"], "left").withColumn("dilated", F.coalesce("dilated", F.lit(False)))


def background_pixels(pixels: DataFrame, keys: list[str], mask: str, steps: int = 50) -> DataFrame:
    """Pixels farther than ``steps`` from any pixel of the mask."""
    return dilated(pixels, keys, mask, steps).filter("not dilated").drop("dilated")


def mapped(value: Column, labels: dict) -> Column:
    """The label of each value by a dictionary; null for values it lacks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), value)


#: Cell types of genotypes (fixed values).
CELLTYPES = {0: "m", 1: "h", 2: "w", -1: "none"}
#: Genotypes of manual labels (fixed values).
MANUAL_LABELS = {"M": 0, "H": 1, "W": 2}


def celltype(genotype: Column) -> Column:
    return mapped(genotype.cast("int"), CELLTYPES)


def manual_labels(measured: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Add manual_label (M, H, W as 0, 1, 2) of labels (keys and label) to measurements that have one; a segment labelled twice takes the least."""
    numbered = labels.select(*keys, mapped(F.upper(F.trim("label")), MANUAL_LABELS).alias("manual_label")).filter("manual_label is not null").groupBy(*keys).agg(F.min("manual_label").alias("manual_label"))
    return measured.join(numbered, keys, "left")


def aggregate_measurements(parts: list[DataFrame], selected_only: bool = False, exclude_boundary: bool = False) -> DataFrame:
    """Outer union of measurements of layers or stacks, optionally without unselected or boundary segments.

    Columns that a part lacks are null. Where a filter's column is null the row is left out.
    """
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    out = out.filter("selected") if selected_only else out
    return out.filter("not boundary") if exclude_boundary else out


def included_layers(layers: DataFrame) -> DataFrame:
    """(stack, layer) of layers with a live load whose included flag is true in its latest live load."""
    live = layers.filter("deleted_at is null").groupBy(*LAYER).agg(F.max_by("included", F.struct("loaded_at", F.coalesce("included", F.lit(False)))).alias("included"))
    return live.filter("included").select(*LAYER)
