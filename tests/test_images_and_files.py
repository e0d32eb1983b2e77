import heapq
import json
import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import images, interchange, measure
from tessera.plans import mosaic
from tessera.sources import experiments
from tessera.streaming import arrivals


def test_filters_by_definition():
    flat = np.full((9, 9), 2.0)
    assert np.allclose(images.gaussian(flat, 1.5), 2.0) and np.allclose(images.median(flat, 2), 2.0)
    dot = np.zeros((9, 9))
    dot[4, 4] = 1.0
    assert images.gaussian(dot, 1.0).sum() == pytest.approx(1.0, abs=1e-6) and images.median(dot, 1).sum() == 0
    assert images.equalise(flat).sum() == 0
    ramp = np.arange(64.0).reshape(8, 8)
    out = images.equalise(ramp, 2, 1.0)
    assert 0 <= out.min() and out.max() <= 1


def test_distance_by_brute_force():
    mask = np.random.default_rng(2).random((12, 15)) > 0.2
    outside = np.argwhere(~mask)
    want = np.array([[0.0 if not mask[r, c] else np.sqrt(((outside - (r, c)) ** 2).sum(axis=1).min()) for c in range(15)] for r in range(12)])
    assert np.allclose(images.distance(mask), want)
    assert images.distance(np.zeros((3, 3), dtype=bool)).sum() == 0


def test_distance_of_a_whole_layer_takes_little_memory():
    mask = np.ones((1024, 1024), dtype=bool)
    mask[::64, ::64] = False
    tracemalloc.start()
    done = images.distance(mask)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done[32, 32] == pytest.approx(32 * np.sqrt(2)) and done[0, 1] == 1 and peak < 100_000_000


def test_two_discs_are_two_segments(spark):
    r, c = np.indices((40, 60))
    image = np.where(((r - 20) ** 2 + (c - 18) ** 2 < 100) | ((r - 20) ** 2 + (c - 40) ** 2 < 100), 1.0, 0.1)
    labels = images.segment(image, radius=1, sigma=1.0)
    assert len(set(labels.ravel()) - {0}) == 2 and labels[20, 18] != labels[20, 40]
    assert images.segment(np.ones((10, 10))).sum() == 0
    rows = [("s", 1, int(i), int(j), float(image[i, j])) for i in range(40) for j in range(60)]
    df = spark.createDataFrame(rows, "stack string, layer int, row int, col int, ch0 double")
    assert images.segment_layers(df, ["stack", "layer"], "ch0", radius=1, sigma=1.0).filter("label > 0").select("label").distinct().count() == 2
    assert images.segment_layers(df.limit(0), ["stack", "layer"], "ch0").count() == 0


def test_raster(spark):
    cells = spark.createDataFrame([("s", 1, 5.0, 5.0, 2.0), ("s", 1, 6.0, 5.0, 4.0), ("s", 1, 5000.0, -3.0, 1.0)], "stack string, layer int, x double, y double, ch0 double")
    rows = {(r.row, r.col): r.ch0 for r in images.rasterise(cells, ["stack", "layer"], "ch0", 8).collect()}
    assert rows == {(0, 0): 3.0, (0, 7): 1.0, (7, 0): 0.0, (7, 7): 0.0}


def test_painted_cells_have_their_own_pixels(spark):
    cells = spark.createDataFrame([("s", 1, 5.5, 5.5, 13, 2.0), ("s", 1, 8.5, 5.5, 5, 4.0), ("s", 1, 1023.9, 1024.0, None, 1.0)], "stack string, layer int, x double, y double, pixel_count bigint, ch0 double")
    rows = {(r.row, r.col): r.ch0 for r in images.painted(cells, ["stack", "layer"], "ch0").collect()}
    assert rows[5, 5] == 2.0 and rows[5, 8] == 4.0 and rows[5, 7] == 3.0 and (5, 10) not in rows
    assert rows[1023, 1023] == 1.0 and rows[0, 0] == rows[0, 1023] == 0.0 and len(rows) == 13 + 5 - 1 + 1 + 3


SIL = "file_id bigint, stack string, kind string, written_at timestamp, deleted_at timestamp, body string"


def test_labels_and_contours(spark):
    feud = json.dumps({"layers": [{"id": 0, "contours": [{"id": "3", "label": "M "}, {"id": 4, "label": " "}, {"id": 5}]}, {"id": 1, "contours": None}]})
    layer = json.dumps({"id": 2, "contours": [{"id": 1, "centroid": [1.5, 2.5], "pixel_count": 9, "color_avg": {"r": 1, "ch0": 2, "g": 3}}, {"id": 2}]})
    df = spark.createDataFrame([(1, "s", "feud", None, None, feud), (1, "s", "feud", None, None, feud), (2, "s", "layer", None, None, layer), (3, "s", "layer", None, None, "broken")], SIL)
    assert [tuple(r) for r in interchange.read_labels(df).collect()] == [("s", 0, 3, "M")]
    rows = {r.segment_id: r for r in interchange.read_contours(df).collect()}
    assert rows[1].colors == {"ch0": 2.0, "g": 3.0} and rows[1].centroid_x == 1.5 and rows[2].colors is None
    body = interchange.build_feud(interchange.read_labels(df), ["stack"]).first().body
    assert json.loads(body) == {"layers": [{"id": 0, "contours": [{"id": 3, "label": "M"}]}]}


def test_hulls_and_contours(spark):
    square = [("s", 1, r, c) for r in range(4) for c in range(4)] + [("s", 2, r, r) for r in range(4)]
    hulls = interchange.convex_hulls(spark.createDataFrame(square, "stack string, segment_id int, row int, col int"), ["stack", "segment_id"])
    rows = hulls.collect()
    assert len(rows) == 1 and sorted(map(tuple, rows[0].points)) == [(0.0, 0.0), (0.0, 3.0), (3.0, 0.0), (3.0, 3.0)]
    measured = spark.createDataFrame([("s", 1, 1.5, 1.5, 16, 0.5, 0.1)], "stack string, segment_id int, centroid_x double, centroid_y double, pixel_count bigint, ch0 double, ch0_std double")
    assert interchange.build_contours(measured, hulls, ["stack", "segment_id"], {"r": "ch0"}).first().color_avg == {"r": 0.5, "g": 0.0, "b": 0.0}


def tiff(pages):
    out = b"II*\0" + struct.pack("<I", 8)
    for k, p in enumerate(pages):
        start = len(out)
        entries = [(256, 4, 1, p.shape[1]), (257, 4, 1, p.shape[0]), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, start + 2 + 6 * 12 + 4), (279, 4, 1, p.nbytes)]
        after = start + 2 + 6 * 12 + 4 + p.nbytes
        out += struct.pack("<H", 6) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", after if k < len(pages) - 1 else 0) + p.tobytes()
    return out


def test_images_are_read(spark, tmp_path):
    cube = np.arange(2 * 3 * 4, dtype="<u2").reshape(2, 3, 4)
    (tmp_path / "disc.tif").write_bytes(tiff(list(cube)))
    got = {(r.layer, r.row, r.col): r.ch0 for r in experiments.read_images(spark, str(tmp_path / "disc.tif"), 1, 4).collect()}
    assert got == {(k, i, j): cube[k, i, j] / 16 for k in range(2) for i in range(3) for j in range(4)}
    np.save(tmp_path / "cube.npy", np.moveaxis(np.stack([cube, cube + 1]), 0, -1))
    two = experiments.read_images(spark, str(tmp_path / "cube.npy"), 2, 4).filter("layer = 1 and row = 2 and col = 3").first()
    assert (two.ch0, two.ch1) == (23 / 16, 24 / 16)


def test_experiment_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0, 0, 3.0), ("a", 2, 0, 0, 4.0), ("b", 1, 0, 0, 5.0)], "stack string, layer int, row int, col int, ch0 double")
    path = str(tmp_path / "x")
    experiments.write_measurements(df, path)
    assert experiments.read_measurements(spark, path, "a", 2).first().ch0 == 4.0
    assert {r.stack: r.layers for r in experiments.stacks(spark, path).collect()} == {"a": 2, "b": 1}
    assert {r.stack: r.depth for r in experiments.initialise(df, ["ch0"], 3).collect()} == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        experiments.initialise(df, ["ch0"], 2)
    labels = df.select("stack", "layer", "row", "col", F.lit(7).alias("label")).filter("stack = 'a'")
    assert experiments.import_labels(df, labels).filter("label = 7").count() == 2
    with pytest.raises(ValueError):
        experiments.import_labels(df, labels.withColumn("label", F.lit(-1)))
    experiments.save_json(df, str(tmp_path / "j"))
    assert experiments.load_json(spark, str(tmp_path / "j"), "stack string").count() >= 1


def test_stream_counts_each_cell_once(spark, tmp_path):
    from datetime import datetime

    schema = "cell_id bigint, stack string, layer int, measured_at timestamp, ch0 double"
    rows = [(1, "s", 1, datetime(2024, 1, 1, 1), 2.0), (1, "s", 1, datetime(2024, 1, 1, 1), 2.0), (2, "s", 1, datetime(2024, 1, 1, 2), 4.0), (3, "s", 1, datetime(2024, 1, 9), 1.0)]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    out = arrivals.layer_means(arrivals.arrivals(spark, str(tmp_path / "in"), df.schema), "ch0")
    run = out.writeStream.outputMode("update").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(str(r["from"])[:10], r.n, r.mean) for r in spark.table("means").collect()}
    assert ("2024-01-01", 2, 3.0) in got


@pytest.fixture
def odd_cells(spark):
    """Cells that overlap, lie beyond the frame or on a corner, lack an area, a value or a place."""
    rows = [(1, 10.5, 12.2, 80, 0.5), (1, 14.0, 12.0, 120, 0.9), (1, 30.0, 8.0, None, 0.4), (1, 33.0, 30.0, 50, None), (1, 35.0, 31.0, 60, 0.7), (1, -3.0, 70.0, 90, -0.6), (1, 39.9, 0.0, 5, float("nan")), (1, None, 4.0, 90, 3.0)]
    rows += [(2, None, None, 9, 1.0), (3, 20.0, 20.0, 5000, 0.3), (3, 20.0, 22.0, 0, 0.8)]
    return spark.createDataFrame([("s", *r) for r in rows], "stack string, layer int, x double, y double, pixel_count bigint, ch0 double")


def same(left, right):
    a, b = ({(r[0], r[1], r[2], r[3]): r[4] for r in df.collect()} for df in (left, right))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_layers_painted_in_their_task_are_those_of_listed_pixels(spark, odd_cells):
    keys, shape = ["stack", "layer"], {"extent": 40}
    listed = images.painted(odd_cells, keys, "ch0", **shape)
    same(images.preprocess_painted(odd_cells, keys, "ch0", **shape), images.on_images(listed, keys, "ch0", images.preprocess, "value"))
    exact = lambda image: {"row": np.indices(image.shape)[0].ravel(), "col": np.indices(image.shape)[1].ravel(), "v": image.ravel()}
    same(images.on_painted(odd_cells, keys, "ch0", exact, "row int, col int, v double", **shape), images.on_images(listed, keys, "ch0", lambda image: image, "v"))


def test_painted_pixels_are_not_shuffled(spark, data):
    plan = mosaic.QUERIES["image_preprocess"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "_dy" not in plan


def test_labels_of_painted_layers_are_those_of_listed_pixels(spark, odd_cells, data):
    keys, how = ["stack", "layer"], {"radius": 1, "sigma": 1.5}
    listed = images.painted(odd_cells, keys, "ch0", extent=40)
    labels = images.segment_layers(listed, keys, "ch0", **how).filter("label > 0")
    got = images.segment_painted(odd_cells, keys, "ch0", extent=40, **how)
    assert got.count() > 0
    same(got.select(*keys, "row", "col", "label"), labels)
    same(got.select(*keys, "row", "col", "ch0"), labels.join(listed, [*keys, "row", "col"], "left").fillna(0.0).select(*keys, "row", "col", "ch0"))
    plan = mosaic.QUERIES["segment_image"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "raster" not in plan


def dense_gaussian(image, sigma):
    reach = max(1, int(4 * sigma + 0.5))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    for axis in (0, 1):
        padded = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        image = sum(k * np.take(padded, range(i, i + image.shape[axis]), axis=axis) for i, k in enumerate(kernel / kernel.sum()))
    return image


def dense_median(image, radius):
    padded, (h, w), steps = np.pad(image, radius, mode="symmetric"), image.shape, range(-radius, radius + 1)
    return np.median([padded[radius + i : radius + i + h, radius + j : radius + j + w] for i in steps for j in steps if abs(i) + abs(j) <= radius], axis=0)


@pytest.mark.parametrize("shape", [(9, 9), (3, 5), (1, 7), (33, 20), (64, 100)])
@pytest.mark.parametrize("share", [0.0, 0.02, 0.3, 1.0])
def test_filters_that_skip_empty_pixels_are_those_of_all_pixels(shape, share):
    rng = np.random.default_rng(3)
    image = np.where(rng.random(shape) < share, rng.normal(size=shape), 0.0)
    assert all(np.array_equal(images.gaussian(image, s), dense_gaussian(image, s)) for s in (0.5, 1.5, 2.0))
    assert all(np.array_equal(images.median(image, r), dense_median(image, r)) for r in (0, 1, 2) if r <= min(shape))


def test_filters_of_a_layer_take_memory_for_a_few_images_only():
    rng = np.random.default_rng(4)
    image = images.paint_discs(*rng.integers(0, 1024, (2, 200)), np.full(200, 9.5), rng.random(200), 1024)
    tracemalloc.start()
    done = images.preprocess(image)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < done.min() < done.max() <= 1 + 1e-9 and peak < 10 * image.nbytes


@pytest.mark.parametrize("lift", [-3.0, 0.0, 0.4, 3.0])
def test_equalised_by_definition_whatever_the_level_of_zero(lift):
    rng = np.random.default_rng(5)
    image = np.where(rng.random((40, 40)) < 0.3, rng.random((40, 40)), 0.0) + lift
    low, high = image.min(), image.max()
    level = np.minimum(((image - low) / (high - low) * 256).astype(int), 255)
    done = images.equalise(image, 4, 0.03)
    for r, c in ((0, 0), (3, 2), (39, 39), (39, 0)):  # beyond the outer tile centres a single tile counts
        tile = level[r // 10 * 10 : r // 10 * 10 + 10, c // 10 * 10 : c // 10 * 10 + 10]
        counts = np.bincount(tile.ravel(), minlength=256).astype(float)
        counts = np.minimum(counts, 3) + np.maximum(counts - 3, 0).sum() / 256
        assert done[r, c] == pytest.approx(np.cumsum(counts)[level[r, c]] / 100)


def flooded_pixel_by_pixel(mask, markers, sigma, line):
    d, (h, w) = dense_gaussian(images.distance(mask), sigma), mask.shape
    out, seen, queue = markers.copy(), markers > 0, []
    near = lambda r, c: [(i, j) for i, j in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if 0 <= i < h and 0 <= j < w]
    todo = [tuple(p) for p in np.argwhere(markers > 0)]
    turn = 0
    while todo or queue:
        if todo:
            r, c = todo.pop(0)
        else:
            _, _, r, c = heapq.heappop(queue)
            around = {int(out[p]) for p in near(r, c)} - {0}
            if len(around) > 1 and line:
                continue
            out[r, c] = min(around)
        for p in near(r, c):
            if mask[p] and not seen[p]:
                seen[p], turn = True, turn + 1
                heapq.heappush(queue, (-d[p], turn, *p))
    return out * mask


@pytest.mark.parametrize("share", [0.02, 0.2, 0.6, 1.0])
def test_flood_of_shared_pieces_is_the_flood_of_all(share):
    rng = np.random.default_rng(6)
    for shape in ((40, 60), (3, 5), (1, 7), (33, 20)):
        for noise in (rng.random(shape), dense_gaussian(rng.normal(size=shape), 2.0)):
            mask = noise <= np.quantile(noise, share)
            for markers in (images.seeds(mask), np.where(rng.random(shape) < 0.05, rng.integers(1, 9, shape), 0)):
                for line in (True, False):
                    assert np.array_equal(images.watershed(mask, markers, 0.5, line), flooded_pixel_by_pixel(mask, markers, 0.5, line))


def test_pieces_of_one_seed_are_not_flooded(monkeypatch):
    pushed = []
    monkeypatch.setattr(heapq, "heappush", lambda queue, x, push=heapq.heappush: (pushed.append(x), push(queue, x)))
    image = images.paint_discs(np.array([20, 20, 20, 60]), np.array([20, 60, 74, 40]), np.full(4, 9.0), np.ones(4), 96)
    labels = images.segment(image)
    assert len(np.unique(labels)) == 5 and 0 < len(pushed) < 0.7 * (image > 0).sum()


def test_mask_of_a_layer_is_that_of_all_its_pixels():
    rng = np.random.default_rng(7)
    for cells, area in ((200, 9.5), (3, 40.0), (400, 30.0)):
        image = images.gaussian(images.paint_discs(*rng.integers(0, 256, (2, cells)), np.full(cells, area), rng.random(cells), 256), 1.0)
        for value in (image, image - 0.2 * (image > 0), image + 1):
            ready = images.equalise(value, 8, 0.03)
            assert np.array_equal(images._bright(value, 8, 0.03), ready >= images.otsu(ready))
    assert images._bright(np.ones((9, 9)), 8, 0.03) is None


def test_segments_measured_in_their_task_are_those_measured_from_pixels(spark, odd_cells, data):
    keys, how = ["stack", "layer"], {"radius": 1, "sigma": 1.5, "extent": 40}
    pixels = measure.measure_segments(images.segment_painted(odd_cells, keys, "ch0", **how), keys, ["ch0"])
    got = images.measure_painted(odd_cells, keys, "ch0", **how)
    assert got.dtypes == pixels.dtypes
    left, right = (sorted(map(tuple, df.collect())) for df in (got, pixels))
    assert len(left) == len(right) > 0 and all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-9) for a, b in zip(left, right, strict=True))
    plan = mosaic.QUERIES["segment_image"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.rpartition("FlatMapGroupsInArrow")[0].count("Aggregate") == 0


def test_very_large_discs_are_painted_in_little_memory():
    rng = np.random.default_rng(8)
    y, x, values = *rng.integers(0, 64, (2, 70_000)), rng.random(70_000)
    tracemalloc.start()
    image = images.paint_discs(y, x, np.full(70_000, 1e5), values, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(image, values.mean()) and peak < 400_000_000
