"""Clusters of similar records by Markov clustering on distributed sparse matrices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.session import cut, discard

#: A node's number is its group's times this plus its bin.
SPAN = 1 << 32


#: Entries of a matrix up to which one side of a product is broadcast: 24 bytes each.
SMALL = 200_000
#: Entries of a row beyond which its key is split over tasks, into so many parts.
HUB, PARTS = 100_000, 64


@dataclass(frozen=True)
class MarkovClusters:
    """``nodes``: node, cluster (least attractor of its system), flow (what the node draws in at the end)."""

    nodes: DataFrame
    iterations: int


def _product(m: DataFrame, entries: int) -> DataFrame:
    """The square of a matrix (i, j, v), partitioned by column.

    Up to :data:`SMALL` entries the left factor is broadcast, and columns stay where they are. Beyond, both
    sides meet on the middle index; the rows of hubs, into which very many columns flow, are split by column
    and meet copies of the hub's own, pruned column.
    """
    left, right = m.select("i", F.col("j").alias("k"), F.col("v").alias("a")), m.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
    if entries <= SMALL:
        pairs = right.repartition("j").join(F.broadcast(left), "k")
    else:
        hubs = F.broadcast(right.groupBy("k").agg(F.count("*").alias("_n")).filter(F.col("_n") > HUB).select("k", F.lit(True).alias("_hub")))
        copies = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
        many = left.join(hubs, "k", "left").withColumn("_part", F.explode(copies)).drop("_hub")
        split = right.join(hubs, "k", "left").withColumn("_part", F.when(F.col("_hub"), F.pmod(F.xxhash64("j"), F.lit(PARTS)).cast("int")).otherwise(0)).drop("_hub")
        pairs = split.join(many, ["k", "_part"])
    return pairs.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def _largest() -> list[Column]:
    """Order of a column's entries: largest first, the node's own before others of that size."""
    return [F.desc(F.round("v", 12)), F.desc(F.col("i") == F.col("j")), F.col("i")]


def _started(edges: DataFrame, keep: int, prune: float) -> DataFrame:
    """The pruned and normalised matrix of a graph. Columns of any length are ranked in parts, then what is left of each part."""
    good = edges.filter("src is not null and dst is not null and weight > 0 and not isnan(weight)")
    m = good.groupBy(F.col("dst").alias("i"), F.col("src").alias("j")).agg(F.sum("weight").alias("v"))
    m = m.join(m.groupBy("j").agg(F.sum("v").alias("_s")), "j").select("i", "j", (F.col("v") / F.col("_s")).alias("v"))
    parts = m.withColumn("_part", F.pmod(F.xxhash64("i"), F.lit(PARTS)))
    first = parts.withColumn("_k", F.row_number().over(Window.partitionBy("j", "_part").orderBy(*_largest()))).filter((F.col("_k") <= keep) | (F.col("v") >= prune))
    column = Window.partitionBy("j")
    kept = first.withColumn("_k", F.row_number().over(column.orderBy(*_largest()))).filter((F.col("_k") <= keep) | (F.col("v") >= prune))
    return kept.select("i", "j", (F.col("v") / F.sum("v").over(column)).alias("v"))


def markov_clusters(edges: DataFrame, inflation: float = 2.0, prune: float = 1e-4, tolerance: float = 1e-3, keep: int = 64, most: int = 200) -> MarkovClusters:
    """Markov clustering of a weighted graph (src, dst, weight), both directions and self loops included.

    The matrix is a table (i, j, v), column j holding where the flow from j goes. Each round squares it
    (see :func:`_product`), raises entries to ``inflation``, normalises columns, and drops entries under ``prune``
    of a column that are not among its ``keep`` largest: all that over windows of one column, which pruning
    keeps to 1 / ``prune`` + ``keep`` entries. Before the first round the graph is pruned likewise, so a hub's
    column is short however many links it has. Writing the matrix to the shared folder also observes its
    size and how far it has come, so a round is one job. It ends when every column's largest entry equals
    its sum of squares within ``tolerance`` (no column is undecided); a matrix that still moves after ``most``
    rounds is an error, never a result.

    A node that keeps flow to itself is an attractor; attractors that flow to each other are one system,
    named after its least node. Each node belongs to the system that takes most of its flow, ties to the
    least. Edges with a null end or a weight that is null, NaN or not positive do not count; repeated
    edges add up. No edges, no nodes.
    """
    column = Window.partitionBy("j")
    seen = Observation()
    m = cut(_started(edges, keep, prune).observe(seen, F.count(F.lit(1)).alias("entries")), "markov")
    entries = seen.get["entries"]
    for done in range(1, most + 1):
        raised = _product(m, entries).withColumn("v", F.pow("v", F.lit(inflation))).withColumn("v", F.col("v") / F.sum("v").over(column))
        kept = raised.withColumn("_k", F.row_number().over(column.orderBy(*_largest()))).filter((F.col("v") >= prune) | (F.col("_k") <= keep))
        scaled = kept.withColumn("v", F.col("v") / F.sum("v").over(column)).withColumn("_open", F.max("v").over(column) - F.sum(F.col("v") * F.col("v")).over(column))
        seen = Observation()
        after = cut(scaled.filter("v > 0").observe(seen, F.count(F.lit(1)).alias("entries"), F.max("_open").alias("open")).select("i", "j", "v"), "markov")
        discard(m)
        m, entries, undecided = after, seen.get["entries"], seen.get["open"]
        if undecided is None or undecided < tolerance:
            break
    else:
        raise RuntimeError(f"Markov clustering still moves after {most} rounds: a column is undecided by {undecided:.4g}")
    attractors = m.filter((F.col("i") == F.col("j")) & (F.col("v") > tolerance)).select(F.col("i").alias("a"))
    system = m.join(attractors.withColumnRenamed("a", "j"), "j", "left_semi").filter(F.col("v") > tolerance).groupBy(F.col("j").alias("i")).agg(F.min("i").alias("cluster"))
    to = m.join(system, "i", "left").withColumn("cluster", F.coalesce("cluster", "i")).groupBy("j", "cluster").agg(F.sum("v").alias("v"))
    best = to.groupBy("j").agg(F.min(F.struct((-F.round("v", 9)).alias("v"), "cluster")).alias("b")).select(F.col("j").alias("node"), F.col("b.cluster").alias("cluster"))
    flow = m.groupBy(F.col("i").alias("node")).agg(F.sum("v").alias("flow"))
    nodes = best.join(flow, "node", "left").fillna(0.0, ["flow"])
    return MarkovClusters(cut(nodes, "nodes"), done)


def representatives(nodes: DataFrame, typical: int = 5) -> DataFrame:
    """cluster, node, flow, position: the ``typical`` members of each cluster that draw most flow, ties to the least node.

    Members are ranked in parts first, so a cluster of any size leaves each task as a few rows.
    """
    by_flow = [F.desc(F.round("flow", 6)), F.col("node")]
    parts = nodes.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(PARTS))).withColumn("_k", F.row_number().over(Window.partitionBy("cluster", "_part").orderBy(*by_flow))).filter(F.col("_k") <= typical)
    ranked = parts.withColumn("position", F.row_number().over(Window.partitionBy("cluster").orderBy(*by_flow))).filter(F.col("position") <= typical)
    return ranked.select("cluster", "node", "flow", "position")


def considered_cells(cells: DataFrame) -> DataFrame:
    """cell_id, genotype and ln (logarithm of the marker) of each cell with a valid reading and genotype 0, 1 or 2, once.

    A reading is finite, above 0 and below 1. Copies of a cell carry the same content; were they to
    differ, the least valid genotype and marker would count. Cells without cell_id do not count.
    """
    marker = F.col("clonal_marker")
    valid = cells.filter(F.col("cell_id").isNotNull() & F.col("genotype").isin(0, 1, 2) & (marker > 0) & (marker < 1) & ~F.isnan(marker))
    once = valid.select("cell_id", "genotype", marker).groupBy("cell_id").agg(F.min("genotype").alias("genotype"), F.min("clonal_marker").alias("m"))
    return once.select("cell_id", "genotype", F.ln("m").alias("ln"))


@dataclass(frozen=True)
class MarkerClusters:
    """``bins``: the clustered nodes with their cells' range; ``cells``: cell_id, genotype, ln, node."""

    bins: DataFrame
    cells: DataFrame
    iterations: int


def _node(genotype: Column, ln: Column, width: float) -> Column:
    return genotype.cast("bigint") * SPAN + (F.floor(ln / width) + SPAN // 2)


def marker_clusters(cells: DataFrame, threshold: float = 0.3, bins_per_threshold: int = 6) -> MarkerClusters:
    """Divide cells (cell_id, genotype, ln) by marker: Markov clustering of bins of equal genotype and near-equal marker.

    A node of the graph is a bin of width ``threshold / bins_per_threshold``, so there are at most some
    thousands of nodes whatever the number of cells: logarithms of doubles below 1 lie between -745 and
    0. Two bins are similar if any two of their cells are, by the bins' least and largest logarithm.
    Flow into a bin is weighted by its cells. Partners come from an equi-join on bin plus offset.
    """
    width = threshold / bins_per_threshold
    placed = cut(cells.withColumn("node", _node(F.col("genotype"), F.col("ln"), width)), "cells")
    bins = cut(placed.groupBy("node", "genotype").agg(F.count("*").alias("n"), F.min("ln").alias("lo"), F.max("ln").alias("hi"), F.avg("ln").alias("mid")), "bins")
    up = bins.select(F.col("node").alias("src"), F.col("n").alias("n_src"), F.col("hi").alias("hi_src"), F.explode(F.sequence(F.lit(0), F.lit(bins_per_threshold + 1))).alias("_o")).withColumn("dst", F.col("src") + F.col("_o"))
    near = up.join(bins.select(F.col("node").alias("dst"), F.col("n").alias("n_dst"), "lo"), "dst").filter((F.col("lo") - F.col("hi_src") <= threshold) | (F.col("src") == F.col("dst")))
    edges = near.select("src", "dst", F.col("n_dst").cast("double").alias("weight")).unionByName(near.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n_src").cast("double").alias("weight")))
    found = markov_clusters(edges)
    return MarkerClusters(bins.join(found.nodes, "node"), placed, found.iterations)


def separate_clusters(done: MarkerClusters, threshold: float = 0.3, least_share: float = 0.01) -> DataFrame:
    """The Markov clusters that are exactly sets of mutually similar cells, similar to none outside, and large enough.

    Returns one row per cluster: genotype, cluster, cluster_rank (by lowest marker), n_cells, lo, hi. The
    check runs over the bins alone (see :func:`marker_clusters` for their bound): a cluster's range must
    not exceed ``threshold``, and wherever neighbouring bins of a genotype lie in different clusters, the
    gap between their cells must exceed it.
    """
    order = Window.partitionBy("genotype").orderBy("lo")
    split = lambda shift, gap: (shift("cluster").over(order) != F.col("cluster")) & (gap <= threshold)
    touching = split(F.lag, F.col("lo") - F.lag("hi").over(order)) | split(F.lead, F.lead("lo").over(order) - F.col("hi"))
    marked = done.bins.withColumn("_touches", F.coalesce(touching, F.lit(False))).withColumn("_all", F.sum("n").over(Window.partitionBy("genotype")))
    sets = marked.groupBy("genotype", "cluster").agg(F.sum("n").alias("n_cells"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("_touches").alias("_touches"), F.max("_all").alias("_all"))
    kept = sets.filter((F.col("hi") - F.col("lo") <= threshold) & ~F.col("_touches") & (F.col("n_cells") >= least_share * F.col("_all")))
    return kept.select("genotype", "cluster", F.row_number().over(order).alias("cluster_rank"), "n_cells", "lo", "hi")


def members(done: MarkerClusters, clusters: DataFrame) -> DataFrame:
    """cell_id, genotype, cluster_rank, ln, flow of every cell in ``clusters``. The bins' table is broadcast; its size is bounded."""
    nodes = done.bins.join(clusters.select("cluster", "cluster_rank", "n_cells"), "cluster").select("node", "cluster", "cluster_rank", "n_cells", "flow", "n", "mid")
    return done.cells.join(F.broadcast(nodes), "node")


def described(done: MarkerClusters, clusters: DataFrame, typical: int = 5) -> DataFrame:
    """Each cluster with its size, range and most typical cells.

    Typical are the members that draw most flow: the cells of the strongest-flow nodes (see
    :func:`representatives`). The cells of one node are of one bin and draw the same flow; among them those nearest the
    node's mean come first, ties by cell_id. Only ``typical`` cells per node leave a task.
    """
    strongest = representatives(done.bins.join(clusters.select("cluster"), "cluster", "left_semi"), typical)
    nodes = strongest.join(done.bins.select("node", "mid"), "node").select("node", "cluster", "mid", "position")
    near = [F.col("_off"), F.col("cell_id")]
    off = done.cells.join(F.broadcast(nodes), "node").withColumn("_off", F.abs(F.col("ln") - F.col("mid"))).withColumn("_part", F.pmod(F.xxhash64("cell_id"), F.lit(PARTS)))
    few = off.withColumn("_k", F.row_number().over(Window.partitionBy("node", "_part").orderBy(*near))).filter(F.col("_k") <= typical)
    picks = few.withColumn("_k", F.row_number().over(Window.partitionBy("cluster").orderBy("position", *near))).filter(F.col("_k") <= typical)
    typical_cells = picks.groupBy("cluster").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("_k", "cell_id"))), lambda c: c["cell_id"].cast("string"))).alias("typical_cells"))
    return clusters.join(typical_cells, "cluster").select("genotype", "cluster_rank", "n_cells", F.exp("lo").alias("marker_from"), F.exp("hi").alias("marker_to"), "typical_cells")
