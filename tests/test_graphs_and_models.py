import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graphs, mixture_models
from tessera.plans import mosaic

KEYS = ["stack", "layer"]
CELLS = "stack string, layer int, node bigint, x double, y double, v double, g int"


def points(spark, xy, values=None, labels=None):
    n = len(xy)
    return spark.createDataFrame([("s", 1, i, float(x), float(y), float(v), int(g)) for i, ((x, y), v, g) in enumerate(zip(xy, values or [1.0] * n, labels or [0] * n, strict=True))], CELLS)


def edges(spark, rows):
    return spark.createDataFrame([("s", 1, a, b, float(w)) for a, b, w in rows], "stack string, layer int, src bigint, dst bigint, length double")


@pytest.mark.parametrize("n", [3, 10, 200])
def test_triangles_have_empty_circles(n):
    p = np.random.default_rng(n).random((n, 2)) * 100
    t = graphs.triangulate(p)
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    d = 2 * ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0])
    assert (d > 0).all()
    bb, cc = ((b - a) ** 2).sum(axis=1), ((c - a) ** 2).sum(axis=1)
    u = np.column_stack([((c - a)[:, 1] * bb - (b - a)[:, 1] * cc) / d, ((b - a)[:, 0] * cc - (c - a)[:, 0] * bb) / d])
    gap = ((p[None] - (a + u)[:, None]) ** 2).sum(axis=2) - (u**2).sum(axis=1)[:, None]
    assert (gap > -1e-6 * (u**2).sum(axis=1)[:, None]).all()
    sides, count = np.unique(np.sort(np.vstack([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]]), axis=1), axis=0, return_counts=True)
    assert len(t) == 2 * n - 2 - (count == 1).sum()


def test_square_and_degenerate_layers(spark):
    square = points(spark, [(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 1)])
    found = graphs.triangles(square, KEYS)
    assert found.count() == 4
    listed = graphs.triangle_edges(found, KEYS)
    assert listed.count() == 12 and graphs.undirected(listed, KEYS).count() == 8 and graphs.hull_edges(listed, KEYS).count() == 4
    assert graphs.voronoi_areas(found, KEYS).first().area == pytest.approx(2.0)
    assert graphs.alpha_edges(found, KEYS, 1.1).count() == 4 and graphs.alpha_edges(found, KEYS, 0.9).count() == 0
    assert graphs.drop_longest(listed, KEYS).count() == 8
    assert graphs.triangles(points(spark, [(0, 0), (1, 1), (2, 2)]), KEYS).count() == 0
    assert graphs.triangles(square.limit(0), KEYS).count() == 0


def test_outliers_weights_and_boundaries(spark):
    listed = edges(spark, [(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 4, 4), (4, 5, 100)])
    scores = {r.length: r.score for r in graphs.outlier_scores(listed, KEYS).collect()}
    assert scores[100.0] == pytest.approx(65.4, abs=0.1) and scores[1.0] == 0
    kept = {(r.src, r.dst) for r in graphs.filter_outliers(listed, KEYS).collect()}
    assert kept == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)}  # node 5 takes its only edge back
    assert {(r.src, r.dst) for r in graphs.filter_outliers(listed.filter("dst < 5").unionByName(edges(spark, [(0, 4, 100)])), KEYS).collect()} == {(0, 1), (1, 2), (2, 3), (3, 4)}
    cells = points(spark, [(i, 0) for i in range(3)], [1.0, math.e, math.e**4], [0, 1, 1])
    w = {(r.src, r.dst): r.weight for r in graphs.edge_weights(edges(spark, [(0, 1, 1), (1, 2, 1)]), cells, KEYS, "v").collect()}
    assert w == {(0, 1): pytest.approx(math.exp(-0.5)), (1, 2): pytest.approx(math.exp(-1.5))}
    twice = edges(spark, [(0, 1, 1), (0, 1, 1), (1, 2, 1)])
    assert {r.node: r.boundary for r in graphs.boundary_nodes(twice, cells, KEYS, "g").collect()} == {0: True, 1: True, 2: False}
    assert graphs.filter_long(listed, KEYS, 2.5).count() == 5


def test_neighbours_and_samples(spark):
    path = edges(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1)])
    hops = {(r.node, r.neighbour): r.hops for r in graphs.neighbours(path, KEYS, 2).collect()}
    assert hops[0, 2] == 2 and (0, 3) not in hops and (0, 0) not in hops and len(hops) == 10
    cells = points(spark, [(0, 0), (3, 4), (100, 0)], [1.0, 4.0, 9.0])
    near = graphs.radius_neighbours(cells, KEYS, 6.0)
    assert {(r.node, r.neighbour, r.distance) for r in near.collect()} == {(0, 1, 5.0), (1, 0, 5.0)}
    sampled = {r.node: (r.v_sampled, r.neighbours) for r in graphs.neighbour_means(near, cells, KEYS, "v").collect()}
    assert sampled == {0: (pytest.approx(4.0), 1), 1: (1.0, 1), 2: (1.0, 0)}
    means = {r.node: (r.v_community, r.community_size) for r in graphs.community_means(cells.withColumn("community", F.lit(1)), KEYS, "v").collect()}
    assert means[0] == (pytest.approx(36 ** (1 / 3)), 2)
    z = points(spark, [(0, 0)] * 3, [1.0, 2.0, 3.0]).withColumn("community", F.lit(1))
    assert graphs.community_correlation(z, KEYS, "v").first().correlation == pytest.approx(-0.5)


def test_diffusion_by_hand(spark):
    link = edges(spark, [(0, 1, 1)]).withColumn("weight", F.lit(1.0))
    start = spark.createDataFrame([("s", 1, 0, 1.0, 0.0), ("s", 1, 1, 0.0, 1.0), ("s", 1, 2, 1.0, None)], "stack string, layer int, node bigint, p0 double, p1 double")
    got = {r.node: (r.p0, r.p1) for r in graphs.diffuse(link, start, KEYS, ["p0", "p1"]).collect()}
    assert got[0] == (pytest.approx(10 / 19, abs=1e-6), pytest.approx(9 / 19, abs=1e-6)) and got[1][1] == pytest.approx(10 / 19, abs=1e-6) and got[2] == (pytest.approx(0.1), 0.0)


def test_communities_of_two_cliques(spark):
    rows = [(a, b, 1) for block in (range(4), range(4, 8)) for a in block for b in block if a < b] + [(3, 4, 1)]
    got = graphs.communities(edges(spark, rows).withColumn("weight", F.when((F.col("src") == 3) & (F.col("dst") == 4), 0.1).otherwise(1.0)), points(spark, [(0, 0)] * 9), KEYS)
    groups = {r.node: r.community for r in got.collect()}
    assert len({groups[i] for i in range(4)}) == 1 and len({groups[i] for i in range(4, 8)}) == 1 and groups[0] != groups[7] and groups[8] == 8


def test_communities_that_do_not_settle_are_an_error(spark):
    rows = [(a, a + 1, 1) for a in range(60)]
    chain = edges(spark, rows).withColumn("weight", F.lit(1.0))
    with pytest.raises(RuntimeError, match="still change"):
        graphs.communities(chain, points(spark, [(0, 0)] * 61), KEYS, most=1)
    found = graphs.communities(chain, points(spark, [(0, 0)] * 61), KEYS).collect()
    assert len(found) == 61


def test_outline_subgraph_and_nulls(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (5, 5), (50, 5), (5, 95)]
    cells = points(spark, square)
    rim = graphs.edge_points(edges(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 1)]), cells, KEYS)
    assert {r.node: r.inside for r in graphs.inside_outline(cells, rim, KEYS, height=3.0).filter("node > 3").collect()} == {4: True, 5: False, 6: False}
    assert graphs.inside_outline(cells, rim.limit(0), KEYS).filter("inside").count() == 0
    kept = graphs.subgraph(edges(spark, [(0, 1, 1), (1, 2, 1), (1, None, 1)]), cells.filter("node < 2").union(cells.filter("node = 0")), KEYS)
    assert [(r.src, r.dst) for r in kept.collect()] == [(0, 1)]


def test_correlation_falls_with_distance(spark):
    rng = np.random.default_rng(1)
    xy = rng.random((300, 2)) * 200
    cells = points(spark, xy.tolist(), np.exp(np.sin(xy[:, 0] / 30)).tolist())
    binned = graphs.distance_correlation(cells, KEYS, "v", 60.0, 10.0)
    rows = {r.bin: r.correlation for r in binned.collect()}
    assert rows[0] > 0.8 > rows[5]
    assert graphs.characteristic_length(binned, KEYS, 10.0).first().length > 10


def test_mixture_is_recovered(spark):
    true = mixture_models.Mixture((0.3, 0.4, 0.3), ((-3.0,), (-1.6,), (-0.4,)), ((0.04,), (0.05,), (0.03,)))
    rows = mixture_models.sample(true, spark, 6000)
    best, models = mixture_models.select(rows, ["v0"], 2, 4)
    assert len(best.weights) == 3 and len(models) == 3
    assert np.allclose([m[0] for m in best.means], [-3.0, -1.6, -0.4], atol=0.05) and np.allclose(best.weights, true.weights, atol=0.03)
    exact = mixture_models.fit(rows, ["v0"], 3, step=0.0)
    assert np.allclose([m[0] for m in exact.means], [m[0] for m in best.means], atol=0.002)
    labelled = rows.withColumn("label", mixture_models.most_probable(mixture_models.posterior(best, mixture_models.domain(["v0"], True), 3)))
    assert labelled.filter("label = component").count() > 5900
    shares = labelled.select(mixture_models.responsibilities(best, mixture_models.domain(["v0"], True)).alias("r")).agg(F.max(F.abs(F.aggregate("r", F.lit(0.0), lambda a, x: a + x) - 1))).first()[0]
    assert shares < 1e-9
    assert mixture_models.required_samples(best) > 0 and best.marginal(0).means == best.means
    with pytest.raises(ValueError):
        mixture_models.fit(rows.limit(0), ["v0"], 2)


def test_fit_equals_plain_iterations(spark):
    """Five rounds from the counted percentiles, with a hot value and one far from all components."""
    rng = np.random.default_rng(4)
    drawn = np.round(np.concatenate([rng.normal(0, 1, 600), rng.normal(6, 1, 300), np.full(500, 6.5), [400.0]]), 3)
    rows = spark.createDataFrame([(float(v),) for v in drawn], "v double").repartition(5)
    got = mixture_models.fit(rows, ["v"], 3, log=False, rounds=5, tolerance=0.0)
    n = len(drawn)
    mean = np.sort(drawn)[[math.ceil((i + 0.5) / 3 * n) - 1 for i in range(3)]]
    var, weight = np.full(3, drawn.var() / 9), np.full(3, 1 / 3)
    for _ in range(5):
        logs = np.log(weight) - 0.5 * np.log(2 * np.pi * var) - (drawn[:, None] - mean) ** 2 / (2 * var)
        share = np.exp(logs - logs.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        likelihood = float(np.logaddexp.reduce(logs, axis=1).sum())
        size = share.sum(axis=0)
        weight, mean = size / n, share.T @ drawn / size
        var = np.maximum(share.T @ drawn**2 / size - mean**2, 1e-6)
    order = np.argsort(mean)
    assert got.rows == n and got.log_likelihood == pytest.approx(likelihood, rel=1e-9)
    assert np.allclose([m[0] for m in got.means], mean[order]) and np.allclose(got.weights, weight[order]) and np.allclose([v[0] for v in got.variances], var[order])


def test_shares_far_from_all_components(spark):
    m = mixture_models.Mixture((0.5, 0.5), ((0.0, 0.0), (4.0, 0.0)), ((1.0, 1e-4), (1.0, 1e-4)), log=False)
    row = spark.createDataFrame([(3.0, 5.0)], "v double, w double").select(mixture_models.posterior(m, mixture_models.domain(["v", "w"], False), 2).alias("p")).first()
    assert row.p == pytest.approx([1 / (1 + math.exp(4)), 1 / (1 + math.exp(-4))])


def test_component_groups():
    m = mixture_models.Mixture((0.25,) * 4, ((0.0,), (0.1,), (2.0,), (2.2,)), ((1.0,),) * 4, log=False)
    assert mixture_models.component_labels(m, 2) == [0, 0, 1, 1] and mixture_models.component_labels(m, 9) == [0, 1, 2, 3]


def test_annotation_smooths_a_noisy_cell(spark):
    xy = [(i, j) for i in range(8) for j in range(8)]
    rng = np.random.default_rng(0)
    values = [float(np.exp((0.0 if i < 4 else 2.0) + rng.normal(0, 0.1))) for i, j in xy]
    values[9] = float(np.exp(1.0))
    cells = points(spark, [(i + rng.random() * 0.2, j + rng.random() * 0.2) for i, j in xy], values)
    listed = graphs.triangle_edges(graphs.triangles(cells, KEYS), KEYS)
    got = {r.node: r.label for r in mixture_models.annotate(cells, listed, KEYS, "v", labels=2, components=2).collect()}
    assert sum(got[k] == (0 if i < 4 else 1) for k, (i, j) in enumerate(xy)) >= 62


def test_models_of_queries_are_selected_from_three_to_ten(spark, data, monkeypatch):
    asked = []
    fit_each = mixture_models.fit_each
    monkeypatch.setattr(mixture_models, "fit_each", lambda rows, columns, counts, *args, **settings: asked.append((len(columns), counts)) or fit_each(rows, columns, counts, *args, **settings))
    rows = mosaic.model_select(spark, data).collect()
    best = {s: min((r.bic, r.k) for r in rows if r.stack == s)[1] for s in {r.stack for r in rows}}
    assert {r.k for r in rows} == set(range(3, 11)) and all(r.chosen == (r.k == best[r.stack]) for r in rows)
    mosaic.mixture_labels(spark, data)
    mosaic.annotate(spark, data)
    assert asked == [(1, list(range(3, 11)))] * 2 + [(d, list(range(3, 11))) for d in (2, 1)]


def test_density_and_surface(spark):
    cells = points(spark, [(0, 0), (1, 0), (500, 500)])
    rows = {r.node: r.density for r in mixture_models.kernel_density(cells, KEYS, "x", "y", 10.0).collect()}
    assert rows[0] == pytest.approx((1 + math.exp(-0.005)) / 3 / (200 * math.pi)) and rows[2] == pytest.approx(1 / 3 / (200 * math.pi))
    control, z = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]), np.array([1.0, 2.0, 3.0])
    w, scale = mixture_models.multiquadric(control, z, smooth=0.0)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in control], "x double, y double")
    assert np.allclose([r[0] for r in df.select(mixture_models.surface(F.col("x"), F.col("y"), control, w, scale)).collect()], z)


def test_layers_settle_as_all_together_do(spark):
    rng = np.random.default_rng(5)
    rows = [("s", layer, int(a), int(b), float(rng.choice([0.5, 1.0, rng.random()]))) for layer in range(6) for a, b in rng.integers(0, 40 + layer, (130, 2))]
    rows += [("s", 1, 3, 9999, 5.0), ("s", 2, 4, 5, None), ("s", 7, 1, 2, 1.0)]
    weighted = spark.createDataFrame(rows, "stack string, layer int, src bigint, dst bigint, weight double")
    nodes = spark.createDataFrame([("s", layer, i) for layer in range(7) for i in range(40 + layer)], "stack string, layer int, node bigint")
    want = {tuple(r) for r in graphs.communities(weighted, nodes, KEYS).collect()}
    got = [tuple(r) for r in graphs.layer_communities(weighted, nodes, KEYS).collect()]
    assert set(got) == want and len(got) == len(want) == nodes.count()
    at = spark.range(-50, 50).selectExpr("id * 987654321987 AS node").selectExpr("node", "xxhash64(node, 11) AS h").toPandas()
    assert (graphs._mixed(at["node"].to_numpy(), 11).view(np.int64) == at["h"].to_numpy()).all()


def test_a_layer_that_does_not_settle_is_an_error(spark):
    chain = edges(spark, [(i, i + 1, 1.0) for i in range(60)]).withColumn("weight", F.lit(1.0))
    with pytest.raises(Exception, match="still change their community"):
        graphs.layer_communities(chain, points(spark, [(0, 0)] * 61), KEYS, most=1).collect()


def test_wide_edges_look_up_both_ends_once(spark, monkeypatch):
    xy, looked, plain = [(1, 0), (0, 1), (10, 0), (0, 10), (10, 1)], [], graphs.with_attribute
    monkeypatch.setattr(graphs, "with_attribute", lambda *a: looked.append(a) or plain(*a))
    links = edges(spark, [(a, b, math.dist(xy[a], xy[b])) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3), (2, 4))])
    got = {(r.src, r.dst) for r in graphs.filter_wide(links, points(spark, xy), KEYS).collect()}
    assert got == {(0, 1), (0, 2), (1, 3), (2, 3), (2, 4)} and len(looked) == 1
