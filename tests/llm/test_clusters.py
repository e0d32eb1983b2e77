import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import clusters

SCHEMA = "cell_id bigint, clonal_marker double, genotype int, node bigint, ln double, n string"


def cells(spark, rows):
    return spark.createDataFrame([(i, m, g, 0, 0.0, "clash") for i, m, g in rows], SCHEMA)


def found(spark, rows):
    done = clusters.marker_clusters(clusters.considered_cells(cells(spark, rows)))
    sets = clusters.separate_clusters(done)
    got = [(r.cell_id, r.genotype, r.cluster_rank) for r in clusters.members(done, sets).collect()]
    assert len(got) == len(set(got))
    return set(got), clusters.described(done, sets).collect()


def brute(rows):
    out = set()
    once = {i: (m, g) for i, m, g in rows if i is not None and m is not None and g in (0, 1, 2) and 0 < m < 1}
    for g in (0, 1, 2):
        xs = sorted((math.log(m), i) for i, (m, k) in once.items() if k == g)
        groups: list[list] = []
        for x, i in xs:
            if groups and x - groups[-1][-1][0] <= 0.3:
                groups[-1].append((x, i))
            else:
                groups.append([(x, i)])
        good = [s for s in groups if s[-1][0] - s[0][0] <= 0.3 and len(s) >= 0.01 * len(xs)]
        out |= {(i, g, k) for k, s in enumerate(good, 1) for _, i in s}
    return out


def test_against_brute_force_with_dirt(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, centres in ((0, (-5, -3, -1)), (1, (-4, -2))):
        for c in centres:
            rows += [(len(rows) + k, float(math.exp(c + rng.uniform(-0.12, 0.12))), g) for k in range(200)]
    n = len(rows)
    rows += [(n + k, float(math.exp(-0.9 + 0.02 * k)), 2) for k in range(40)]  # a chain: no cluster
    rows += [(n + 50, math.exp(-7.0), 2), (n + 51, math.exp(-8.0), 0)]  # one of few, one of many
    rows += rows[:30] + [rows[0]] * 50
    rows += [(n + 60, None, 0), (n + 61, 0.5, None), (n + 62, 0.5, -1), (n + 63, float("nan"), 1), (n + 64, float("inf"), 1), (n + 65, 1.0, 1), (n + 66, 0.0, 1), (n + 67, 1e-300, 0), (None, 0.5, 0)]
    got, described = found(spark, rows)
    assert got == brute(rows)
    assert {(r.genotype, r.cluster_rank, r.n_cells) for r in described} == {(g, k, sum(x[1:] == (g, k) for x in got)) for g, k in {x[1:] for x in got}}
    assert all(0 < len(r.typical_cells.split(",")) <= 5 for r in described)


def test_neighbouring_clusters_closer_than_the_threshold_are_none(spark):
    rows = [(k, math.exp(-3 + 0.001 * k), 0) for k in range(100)] + [(200 + k, math.exp(-2.7 + 0.001 * k), 0) for k in range(100)]
    assert found(spark, rows)[0] == brute(rows) == set()


def test_ties_and_empty(spark):
    assert found(spark, [(k, 0.25, 1) for k in range(500)])[0] == {(k, 1, 1) for k in range(500)}
    assert found(spark, []) == (set(), [])


def test_markov_clustering_separates_cliques(spark):
    rows = [(a, b, 1.0) for block in (range(6), range(6, 11)) for a in block for b in block] + [(5, 6, 0.3), (6, 5, 0.3), (20, 20, 1.0), (None, 1, 1.0), (1, 2, float("nan")), (1, 2, -1.0), (3, 4, None)]
    done = clusters.markov_clusters(spark.createDataFrame(rows, "src bigint, dst bigint, weight double"))
    of = {r.node: r.cluster for r in done.nodes.collect()}
    assert len({of[i] for i in range(6)}) == 1 and len({of[i] for i in range(6, 11)}) == 1 and of[0] != of[10] and of[20] == 20
    best = {r.cluster: r.node for r in clusters.representatives(done.nodes, 1).collect()}
    assert set(best) == set(of.values()) and all(of[n] == c for c, n in best.items())


def test_a_hub_of_many_links_and_split_products(spark, monkeypatch):
    """A star, small and with 100,000 links, is one cluster drawn by its hub, also where products are split."""
    n = 100_000
    ids = spark.range(1, n + 1)
    star = ids.select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst")).unionByName(ids.select(F.col("id").alias("src"), F.lit(0).cast("bigint").alias("dst"))).unionByName(spark.range(n + 1).select(F.col("id").alias("src"), F.col("id").alias("dst"))).withColumn("weight", F.lit(1.0))
    big = clusters.markov_clusters(star)
    assert big.nodes.count() == n + 1 and big.nodes.select("cluster").distinct().count() == 1
    assert [r.node for r in clusters.representatives(big.nodes, 1).collect()] == [0]
    monkeypatch.setattr(clusters, "SMALL", 0)
    monkeypatch.setattr(clusters, "HUB", 50)
    small = clusters.markov_clusters(star.filter("src <= 500 and dst <= 500"))
    assert small.nodes.count() == 501 and small.nodes.select("cluster").distinct().count() == 1


def test_a_graph_that_does_not_settle_is_an_error(spark):
    rows = [(a, b, 1.0) for a in range(40) for b in range(40) if abs(a - b) <= 3]
    df = spark.createDataFrame(rows, "src bigint, dst bigint, weight double")
    with pytest.raises(RuntimeError, match="still moves"):
        clusters.markov_clusters(df, most=2)
    assert clusters.markov_clusters(df).iterations > 2


def test_markov_clustering_equals_dense_matrices(spark):
    rng = np.random.default_rng(3)
    a = (rng.random((12, 12)) < 0.3) * rng.random((12, 12))
    a = a + a.T + np.eye(12)
    m = a / a.sum(axis=0)
    for _ in range(60):
        m = (m @ m) ** 2
        m[m < 1e-9] = 0
        m /= m.sum(axis=0)
    rows = [(j, i, float(a[i, j])) for i in range(12) for j in range(12) if a[i, j]]
    of = {r.node: r.cluster for r in clusters.markov_clusters(spark.createDataFrame(rows, "src bigint, dst bigint, weight double")).nodes.collect()}
    dense = m.argmax(axis=0)
    assert all((of[i] == of[j]) == (dense[i] == dense[j]) for i in range(12) for j in range(12))
    assert pytest.approx(1) == m.sum(axis=0).max()
