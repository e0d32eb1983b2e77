import pytest
from pyspark.sql import functions as F

from tessera.operators import measure

PIXELS = "stack string, layer int, row int, col int, label int, ch0 double, ch1 double"


def toy(spark):
    return spark.createDataFrame([("s", 1, 0, 0, 1, 1.0, 2.0), ("s", 1, 0, 1, 1, 3.0, None), ("s", 1, 5, 5, 0, 9.0, 9.0), ("s", 1, 3, 3, 2, 4.0, 0.0), ("s", 1, 4, 3, None, 4.0, 0.0)], PIXELS)


def test_segment_measure_by_hand(spark):
    rows = {r.segment_id: r for r in measure.measure_segments(toy(spark), measure.LAYER, ["ch0", "ch1"]).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].centroid_x, rows[1].centroid_y, rows[1].ch0, rows[1].ch0_std, rows[1].pixel_count, rows[1].ch1) == (0.5, 0.0, 2.0, 1.0, 2, 2.0)


def test_normalise_by_zero_is_null(spark):
    m = measure.normalise(measure.measure_segments(toy(spark), measure.LAYER, ["ch0", "ch1"]), "ch1", ["ch0", "ch1"])
    assert {r.segment_id: r.ch0_normalized for r in m.collect()} == {1: 1.0, 2: None}


def test_resampling_weights_by_hand(spark):
    df = spark.createDataFrame([("a", x) for x in (0, 0, 1, 3, None)], "k string, x int")
    rows = {r.x: (r.multiplicity, r.weight) for r in measure.resampling_weights(df, ["k"], "x").collect()}
    assert rows[0] == (2, pytest.approx(1 / 6)) and rows[1] == (1, pytest.approx(2 / 3)) and rows[3][1] == 0
    drawn = measure.resample(df.withColumn("x", F.col("x").cast("double")), ["k"], "x", 300).groupBy("x").count().collect()
    assert {r.x: r["count"] for r in drawn} == {0.0: 100, 1.0: 200}


def test_bleedthrough_recovers_a_line(spark):
    df = spark.range(1, 400).select(F.lit("s").alias("stack"), F.lit(1).alias("layer"), (F.col("id") / 400).alias("ch0"), (0.1 + 0.5 * F.col("id") / 400).alias("ch1"), F.lit(2.0).alias("ch2"))
    fit = measure.fit_bleedthrough(df, measure.LAYER, "ch0", "ch1")
    r = fit.first()
    assert (r.b, r.m) == (pytest.approx(0.1), pytest.approx(0.5))
    done = measure.correct_bleedthrough(df, fit, measure.LAYER, "ch0", "ch1", "ch2").agg(F.max(F.abs("ch1c"))).first()[0]
    assert done < 1e-9
    b, m = measure.fit_bleedthrough_gamma(df, "ch0", "ch1")
    assert (b, m) == (pytest.approx(0.1, abs=1e-4), pytest.approx(0.5, abs=1e-4))


def test_masks_dilation_and_paint(spark):
    grid = spark.range(49).select(F.lit("s").alias("stack"), F.lit(1).alias("layer"), F.floor(F.col("id") / 7).cast("int").alias("row"), (F.col("id") % 7).cast("int").alias("col")).withColumn("ch0", F.when((F.col("row") == 3) & (F.col("col") == 3), 10.0).otherwise(1.0))
    masked = measure.otsu_mask(grid, measure.LAYER, "ch0")
    assert masked.filter("mask").count() == 1
    assert measure.dilated(masked, measure.LAYER, "mask", 2).filter("dilated").count() == 25
    assert measure.background_pixels(masked, measure.LAYER, "mask", 2).count() == 24
    assert measure.otsu_thresholds(grid.withColumn("ch0", F.lit(3.0)), measure.LAYER, "ch0").first().threshold == 3.0
    labelled = grid.withColumn("label", F.when(F.col("ch0") > 5, 4).otherwise(0))
    values = spark.createDataFrame([("s", 1, 4, 0.5)], "stack string, layer int, segment_id int, v double")
    painted = measure.paint(labelled, values, measure.LAYER, "v").groupBy("v_mask").count().collect()
    assert {r.v_mask: r["count"] for r in painted} == {0.5: 1, -1.0: 48}
    assert measure.drop_small_segments(labelled, measure.LAYER, 2).filter("label <> 0").count() == 0
    assert measure.drop_edge_segments(labelled.withColumn("label", F.lit(1)), measure.LAYER).count() == 0


def test_union_rgb_order_and_units(spark):
    a = spark.createDataFrame([(1, True, False)], "segment_id int, selected boolean, boundary boolean")
    b = spark.createDataFrame([(2, True, True, 5.0), (3, None, False, 1.0)], "segment_id int, selected boolean, boundary boolean, extra double")
    assert [r.segment_id for r in measure.aggregate_measurements([a, b], True, True).collect()] == [1]
    rgb = measure.to_rgb(toy(spark), {"g": "ch1"}).agg(F.sum("r"), F.sum("g")).first()
    assert tuple(rgb) == (0.0, 11.0)
    swapped = measure.reorder_channels(toy(spark), [1, 0])
    assert swapped.filter("label = 1 and col = 0").first().ch0 == 2.0
    assert measure.overflowing(toy(spark), ["ch0"], 3).count() == 1 and measure.unit_pixels(toy(spark), ["ch0"], 1).agg(F.max("ch0")).first()[0] == 4.5


def test_labels(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (-1,), (9,), (None,)], "g int")
    assert [r.t for r in df.select(measure.celltype(F.col("g")).alias("t")).collect()] == ["m", "h", "w", "none", None, None]
    cells = spark.createDataFrame([("s", 1, 1), ("s", 1, 2)], "stack string, layer int, segment_id int")
    labels = spark.createDataFrame([("s", 1, 1, " w "), ("s", 1, 1, "h"), ("s", 1, 3, "M")], "stack string, layer int, segment_id int, label string")
    assert {r.segment_id: r.manual_label for r in measure.manual_labels(cells, labels, ["stack", "layer", "segment_id"]).collect()} == {1: 1, 2: None}
