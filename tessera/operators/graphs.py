"""Spatial graphs of the cells of a layer.

A layer is one image, so its cells are few; triangulations run on one layer per group. Everything else is
joins and aggregates on edge tables: keys, src, dst, length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.session import cut, spread


def triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles (rows of three positions, counter-clockwise) of distinct points, by inserting one point at a time.

    A point removes the triangles whose circumcircle holds it and joins the border of the hole. Fewer than
    three points, or points on one line, have no triangles.
    """
    n = len(points)
    if n < 3:
        return np.empty((0, 3), dtype=np.int64)
    span = max(float(np.ptp(points, axis=0).max()), 1e-9)
    cx, cy = points.mean(axis=0)
    xs = [*points[:, 0].tolist(), cx - 1e4 * span, cx + 1e4 * span, cx]
    ys = [*points[:, 1].tolist(), cy - 6e3 * span, cy - 6e3 * span, cy + 1.2e4 * span]
    room = 2 * n + 8
    corners: list[tuple[int, int, int]] = [(n, n + 1, n + 2)]
    circle_x, circle_y, circle_r = np.zeros(room), np.zeros(room), np.full(room, -1.0)

    def place(slot: int, a: int, b: int, c: int) -> None:
        corners[slot] = (a, b, c)
        ux, uy, vx, vy = xs[b] - xs[a], ys[b] - ys[a], xs[c] - xs[a], ys[c] - ys[a]
        d = 2 * (ux * vy - uy * vx)
        if abs(d) < 1e-14 * span * span:  # flat for now: the next point replaces it
            circle_x[slot], circle_y[slot], circle_r[slot] = cx, cy, 1e150
            return
        uu, vv = ux * ux + uy * uy, vx * vx + vy * vy
        ox, oy = (vy * uu - uy * vv) / d, (ux * vv - vx * uu) / d
        circle_x[slot], circle_y[slot], circle_r[slot] = xs[a] + ox, ys[a] + oy, ox * ox + oy * oy

    place(0, n, n + 1, n + 2)
    for p in np.lexsort((points[:, 1], points[:, 0])).tolist():
        m = len(corners)
        gap = (circle_x[:m] - xs[p]) ** 2 + (circle_y[:m] - ys[p]) ** 2 - circle_r[:m]
        hole = np.flatnonzero(gap < -1e-12 * circle_r[:m]).tolist()
        border: dict[tuple[int, int], None] = {}
        for t in hole:
            a, b, c = corners[t]
            for e in ((a, b), (b, c), (c, a)):
                if (e[1], e[0]) in border:
                    del border[e[1], e[0]]
                else:
                    border[e] = None
        slots = hole + list(range(m, m + max(0, len(border) - len(hole))))
        if slots and slots[-1] >= len(circle_x):
            circle_x, circle_y, circle_r = (np.concatenate([v, np.full(room, fill)]) for v, fill in ((circle_x, 0.0), (circle_y, 0.0), (circle_r, -1.0)))
        corners.extend([(n, n, n)] * (len(slots) - len(hole)))
        for slot, (a, b) in zip(slots, border, strict=False):
            place(slot, a, b, p)
        for slot in slots[len(border) :]:
            corners[slot] = (n, n, n)
            circle_r[slot] = -1.0
    found = np.array([t for t in corners if max(t) < n], dtype=np.int64).reshape(-1, 3)
    a, b, c = (points[found[:, i]] for i in range(3))
    area = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    return found[np.abs(area) > 1e-9 * span * span]


def triangles(cells: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """Triangles per group of keys: a, b, c (nodes), with x and y of each corner. Nodes at the same place count as the least of them."""
    types = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, triangle int, a bigint, b bigint, c bigint, ax double, ay double, bx double, by double, cx double, cy double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(node).drop_duplicates(["x", "y"], ignore_index=True)
        points = group[["x", "y"]].to_numpy(dtype=float)
        t = triangulate(points)
        t = t[np.lexsort(np.sort(t, axis=1).T[::-1])] if len(t) else t
        if not len(t):
            return empty
        ids = group[node].to_numpy()
        out = {k: group[k].iloc[0] for k in keys} | {"triangle": np.arange(len(t))} | {c: ids[t[:, i]] for i, c in enumerate("abc")}
        return pd.DataFrame(out | {f"{c}{d}": points[t[:, i], j] for i, c in enumerate("abc") for j, d in enumerate("xy")})

    empty = pd.DataFrame({c.split()[0].strip("`"): pd.Series(dtype={"int": "int32", "bigint": "int64", "double": "float64"}.get(c.split()[1], "object")) for c in schema.split(", ")})
    used = cells.select(*keys, F.col(node).cast("bigint").alias(node), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(F.col(node).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    return spread(used, keys).groupBy(*keys).applyInPandas(run, schema)


def triangle_edges(found: DataFrame, keys: list[str]) -> DataFrame:
    """Three edges per triangle with their length, so an edge inside the hull appears twice: keys, triangle, src, dst, length."""
    side = lambda s, d: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.hypot(F.col(f"{s}x") - F.col(f"{d}x"), F.col(f"{s}y") - F.col(f"{d}y")).alias("length"))
    return found.withColumn("e", F.explode(F.array(side("a", "b"), side("b", "c"), side("c", "a")))).select(*keys, "triangle", "e.*")


def undirected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each edge once, src < dst."""
    return edges.groupBy(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("length").alias("length"))


def hull_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of a single triangle."""
    return edges.groupBy(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("length").alias("length"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")


def outlier_scores(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``score``: 0.6745 |length - median| / MAD, 0 below the median. Where the MAD is 0, longer edges have infinite scores."""
    middle = edges.groupBy(*keys).agg(F.median("length").alias("_m"))
    off = edges.join(middle, keys).withColumn("_d", F.abs(F.col("length") - F.col("_m")))
    mad = off.groupBy(*keys).agg(F.median("_d").alias("_mad"))
    score = F.when(F.col("length") <= F.col("_m"), 0.0).when(F.col("_mad") > 0, 0.6745 * F.col("_d") / F.col("_mad")).otherwise(F.lit(float("inf")))
    return off.join(mad, keys).withColumn("score", score).drop("_m", "_d", "_mad")


def _reconnected(kept: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """``kept`` with the shortest dropped edge of each node that has none left."""
    ends = lambda df: df.withColumn("node", F.explode(F.array("src", "dst")))
    alone = ends(dropped).join(ends(kept).select(*keys, "node").distinct(), [*keys, "node"], "left_anti")
    back = alone.groupBy(*keys, "node").agg(F.min(F.struct("length", "src", "dst")).alias("e")).select(*keys, "e.src", "e.dst", "e.length").distinct()
    return kept.select(*keys, "src", "dst", "length").unionByName(back)


def filter_outliers(edges: DataFrame, keys: list[str], threshold: float = 3.0) -> DataFrame:
    """Edges without those of unusual length; a node that would lose all keeps its shortest. Repeated edges count repeatedly in the median."""
    s = outlier_scores(edges, keys)
    return _reconnected(s.filter(F.col("score") <= threshold), s.filter(F.col("score") > threshold), keys)


def filter_long(edges: DataFrame, keys: list[str], most: float = 0.1) -> DataFrame:
    """Edges of at most ``most``; a node that would lose all keeps its shortest."""
    return _reconnected(edges.filter(F.col("length") <= most), edges.filter(F.col("length") > most), keys)


def drop_hull(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that two triangles share."""
    rim = hull_edges(edges, keys).select(*keys, F.col("src").alias("_a"), F.col("dst").alias("_b"))
    paired = edges.withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst"))
    return paired.join(rim, [*keys, "_a", "_b"], "left_anti").drop("_a", "_b")


def filter_wide(edges: DataFrame, cells: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """Edges without outer ones that span too wide an angle about the origin; a node that would lose all keeps its shortest.

    Outer are edges whose nearer end lies beyond the median of such radii, too wide those of at least
    5.5 / sqrt(cells of the layer).
    """
    ends = cells.select(*keys, node, F.hypot("x", "y").alias("radius"), F.atan2("y", "x").alias("angle"))
    polar = with_attribute(edges, ends.select(*keys, node, F.struct("radius", "angle").alias("_p")), keys, "_p", node)
    turn = F.abs(F.col("_p_src.angle") - F.col("_p_dst.angle"))
    polar = polar.withColumn("_r", F.least("_p_src.radius", "_p_dst.radius")).withColumn("_t", F.when(turn > F.lit(3.141592653589793), 2 * 3.141592653589793 - turn).otherwise(turn))
    middle = polar.groupBy(*keys).agg(F.median("_r").alias("_m")).join(cells.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    judged = polar.join(middle, keys).withColumn("_wide", (F.col("_r") > F.col("_m")) & (F.col("_t") >= 5.5 / F.sqrt("_n")))
    return _reconnected(judged.filter("not _wide"), judged.filter("_wide"), keys)


def drop_longest(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges without the longest of each triangle (ties: the largest src and dst)."""
    worst = Window.partitionBy(*keys, "triangle").orderBy(F.desc("length"), F.desc("src"), F.desc("dst"))
    return edges.withColumn("_r", F.row_number().over(worst)).filter("_r > 1").drop("_r")


def with_attribute(edges: DataFrame, cells: DataFrame, keys: list[str], attribute: str, node: str = "node") -> DataFrame:
    """Add the attribute of both ends, {attribute}_src and {attribute}_dst, by two joins."""
    side = lambda s: cells.select(*keys, F.col(node).alias(s), F.col(attribute).alias(f"{attribute}_{s}"))
    return edges.join(side("src"), [*keys, "src"]).join(side("dst"), [*keys, "dst"])


def edge_weights(edges: DataFrame, cells: DataFrame, keys: list[str], attribute: str, logratio: bool = True, distance: bool = False, node: str = "node") -> DataFrame:
    """Add ``weight`` exp(-energy / mean energy of the group), the energy being the difference, or the difference of logarithms, of the ends.

    ``distance``: 1 - weight. Values that are not positive have no logarithm: such edges have null weight.
    """
    value = lambda s: F.when(F.col(f"{attribute}_{s}") > 0, F.ln(f"{attribute}_{s}")) if logratio else F.col(f"{attribute}_{s}")
    energies = with_attribute(edges, cells, keys, attribute, node).withColumn("energy", F.abs(value("src") - value("dst")))
    means = energies.groupBy(*keys).agg(F.avg("energy").alias("_mean"))
    w = F.exp(-F.col("energy") / F.nullif(F.col("_mean"), F.lit(0.0)))
    return energies.join(means, keys).withColumn("weight", 1 - w if distance else w).drop("_mean")


def boundary_nodes(edges: DataFrame, cells: DataFrame, keys: list[str], label: str, most: int = 1, node: str = "node") -> DataFrame:
    """Add ``boundary``: whether a cell has more than ``most`` edges to cells of another label, edges counted as often as listed."""
    cross = with_attribute(edges, cells, keys, label, node).filter(F.col(f"{label}_src") != F.col(f"{label}_dst"))
    counts = cross.withColumn("_node", F.explode(F.array("src", "dst"))).groupBy(*keys, F.col("_node").alias(node)).agg(F.count("*").alias("_n"))
    return cells.drop("boundary").join(counts, [*keys, node], "left").withColumn("boundary", F.coalesce(F.col("_n") > most, F.lit(False))).drop("_n")


def triangle_labels(found: DataFrame, cells: DataFrame, keys: list[str], label: str, node: str = "node") -> DataFrame:
    """Add ``label`` of each triangle: that of two corners, else of the first."""
    for corner in "abc":
        found = found.join(cells.select(*keys, F.col(node).alias(corner), F.col(label).alias(f"_{corner}")), [*keys, corner], "left")
    return found.withColumn("label", F.when((F.col("_b") == F.col("_c")) & F.coalesce(F.col("_a") != F.col("_b"), F.lit(True)), F.col("_b")).otherwise(F.col("_a"))).drop("_a", "_b", "_c")


def neighbours(edges: DataFrame, keys: list[str], depth: int = 1) -> DataFrame:
    """Pairs (node, neighbour, hops) within ``depth`` steps, the node itself left out; one join per step, the fewest hops of a pair by one aggregate.

    The edges in both directions are written once, so every step reads them instead of making them anew.
    """
    both = edges.select(*keys, "src", "dst").unionByName(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    if depth > 1:
        both = cut(both, "both")
    reach = both.select(*keys, F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit(1).alias("hops"))
    for hop in range(2, depth + 1):
        edge = reach.filter(F.col("hops") == hop - 1)
        step = edge.select(*keys, "node", F.col("neighbour").alias("src")).join(both, [*keys, "src"]).select(*keys, "node", F.col("dst").alias("neighbour"), F.lit(hop).alias("hops")).filter("node <> neighbour")
        reach = reach.unionByName(step).groupBy(*keys, "node", "neighbour").agg(F.min("hops").alias("hops"))
        if hop < depth:
            reach = cut(reach, "reach")
    return reach


def radius_neighbours(cells: DataFrame, keys: list[str], radius: float, node: str = "node") -> DataFrame:
    """Pairs (node, neighbour, distance) of cells closer than ``radius``, by an equi-join on squares of that width and their eight neighbours."""
    placed = cells.select(*keys, node, "x", "y", F.floor(F.col("x") / radius).alias("_gx"), F.floor(F.col("y") / radius).alias("_gy"))
    rounds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = placed.withColumn("_o", F.explode(rounds)).select(*keys, F.col(node).alias("_node"), F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("_gx") + F.col("_o.i")).alias("_gx"), (F.col("_gy") + F.col("_o.j")).alias("_gy"))
    d = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    return spread.join(placed, [*keys, "_gx", "_gy"]).filter((F.col("_node") != F.col(node)) & (d < radius)).select(*keys, F.col("_node").alias("node"), F.col(node).alias("neighbour"), d.alias("distance"))


def neighbour_means(pairs: DataFrame, cells: DataFrame, keys: list[str], attribute: str, log: bool = True, node: str = "node") -> DataFrame:
    """Add to each cell the (geometric) mean of ``attribute`` over its neighbours and their number; a cell without any has mean 1 (log) or 0 and number 0."""
    value = F.when(F.col(attribute) > 0, F.ln(attribute)) if log else F.col(attribute)
    sums = pairs.join(cells.select(*keys, F.col(node).alias("neighbour"), value.alias("_v")), [*keys, "neighbour"]).groupBy(*keys, F.col("node").alias(node)).agg(F.avg("_v").alias("_m"), F.count("*").alias("neighbours"))
    mean = F.coalesce("_m", F.lit(0.0))
    return cells.join(sums, [*keys, node], "left").withColumn(f"{attribute}_sampled", F.exp(mean) if log else mean).withColumn("neighbours", F.coalesce("neighbours", F.lit(0))).drop("_m")


def community_means(cells: DataFrame, keys: list[str], attribute: str, community: str = "community", log: bool = True) -> DataFrame:
    """Add the (geometric) mean of the cell's community, itself included, and the number of others in it. A small aggregate joined back."""
    value = F.when(F.col(attribute) > 0, F.ln(attribute)) if log else F.col(attribute)
    means = cells.groupBy(*keys, community).agg(F.avg(value).alias("_m"), (F.count("*") - 1).alias("community_size"))
    return cells.join(means, [*keys, community]).withColumn(f"{attribute}_community", F.exp("_m") if log else F.col("_m")).drop("_m")


def community_correlation(cells: DataFrame, keys: list[str], value: str, community: str = "community") -> DataFrame:
    """Mean product of the z-scores of all pairs within communities, per group, from two sums: ((sum z)^2 - sum z^2) / 2."""
    stats = cells.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    z = cells.join(stats, keys).withColumn("_z", (F.col(value) - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0))).filter("_z is not null")
    sums = z.groupBy(*keys, community).agg(F.sum("_z").alias("s"), F.sum(F.col("_z") * F.col("_z")).alias("q"), F.count("*").alias("n"))
    return sums.groupBy(*keys).agg((F.sum((F.col("s") * F.col("s") - F.col("q")) / 2) / F.nullif(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).alias("correlation"))


def fluctuations(cells: DataFrame, keys: list[str], attribute: str, log: bool = True, node: str = "node") -> DataFrame:
    """Deviation of each cell's (log) attribute from its layer's mean, over the layer's population deviation: keys, node, x, y, z."""
    value = F.when(F.col(attribute) > 0, F.ln(attribute)) if log else F.col(attribute)
    v = cells.select(*keys, node, "x", "y", value.alias("_v")).filter("_v is not null")
    stats = v.groupBy(*keys).agg(F.avg("_v").alias("_mu"), F.stddev_pop("_v").alias("_sd"))
    return v.join(stats, keys).select(*keys, node, "x", "y", ((F.col("_v") - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0))).alias("z"))


def distance_correlation(cells: DataFrame, keys: list[str], attribute: str, reach: float, width: float, node: str = "node") -> DataFrame:
    """Mean product of fluctuations of the pairs of a layer by distance, in steps of ``width`` up to ``reach``: bin, pairs, correlation.

    Pairs come from the grid join of :func:`radius_neighbours`, so none farther than ``reach`` are made.
    """
    z = fluctuations(cells, keys, attribute, node=node)
    near = radius_neighbours(z, keys, reach, node).filter(F.col("node") < F.col("neighbour"))
    side = lambda s, c: z.select(*keys, F.col(node).alias(s), F.col("z").alias(c))
    product = near.join(side("node", "_a"), [*keys, "node"]).join(side("neighbour", "_b"), [*keys, "neighbour"])
    return product.groupBy(*keys, F.floor(F.col("distance") / width).cast("int").alias("bin")).agg(F.count("*").alias("pairs"), F.avg(F.col("_a") * F.col("_b")).alias("correlation"))


def characteristic_length(binned: DataFrame, keys: list[str], width: float, fraction: float = 0.01) -> DataFrame:
    """Length over which the correlation falls to 1/e: the slope of ln(correlation) over distance up to the first bin under ``fraction`` of the largest.

    Null where fewer than two bins remain or the correlation does not fall.
    """
    tops = binned.groupBy(*keys).agg(F.max("correlation").alias("_top"))
    low = binned.join(tops, keys).filter(F.col("correlation") < F.col("_top") * fraction).groupBy(*keys).agg(F.min("bin").alias("_cut"))
    used = binned.join(low, keys, "left").filter((F.col("correlation") > 0) & (F.col("_cut").isNull() | (F.col("bin") < F.col("_cut"))))
    slope = used.groupBy(*keys).agg(F.regr_slope(F.ln("correlation"), (F.col("bin") + 0.5) * width).alias("_m"))
    return slope.select(*keys, F.when(F.col("_m") < 0, -1 / F.col("_m")).alias("length"))


def hop_correlation(edges: DataFrame, cells: DataFrame, keys: list[str], attribute: str, hops: int, node: str = "node") -> DataFrame:
    """Mean product of fluctuations of pairs by number of steps between them."""
    z = fluctuations(cells, keys, attribute, node=node)
    side = lambda s, c: z.select(*keys, F.col(node).alias(s), F.col("z").alias(c))
    pairs = neighbours(edges, keys, hops).filter(F.col("node") < F.col("neighbour"))
    return pairs.join(side("node", "_a"), [*keys, "node"]).join(side("neighbour", "_b"), [*keys, "neighbour"]).groupBy(*keys, "hops").agg(F.count("*").alias("pairs"), F.avg(F.col("_a") * F.col("_b")).alias("correlation"))


def alpha_edges(found: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Outline of the triangles whose circumradius is under ``alpha``: the edges that only one of them has. Flat triangles do not count."""
    a, b, c = (F.hypot(F.col(f"{p}x") - F.col(f"{q}x"), F.col(f"{p}y") - F.col(f"{q}y")) for p, q in ("bc", "ca", "ab"))
    area = F.abs((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))) / 2
    return hull_edges(triangle_edges(found.filter(a * b * c / (4 * F.nullif(area, F.lit(0.0))) < alpha), keys), keys)


def voronoi_areas(found: DataFrame, keys: list[str]) -> DataFrame:
    """Area of the bounded Voronoi cell of each node not on the hull: the polygon of its triangles' circumcentres in order of angle."""
    d = 2 * ((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax")))
    bb = F.pow(F.col("bx") - F.col("ax"), F.lit(2.0)) + F.pow(F.col("by") - F.col("ay"), F.lit(2.0))
    cc = F.pow(F.col("cx") - F.col("ax"), F.lit(2.0)) + F.pow(F.col("cy") - F.col("ay"), F.lit(2.0))
    ux = F.col("ax") + ((F.col("cy") - F.col("ay")) * bb - (F.col("by") - F.col("ay")) * cc) / d
    uy = F.col("ay") + ((F.col("bx") - F.col("ax")) * cc - (F.col("cx") - F.col("ax")) * bb) / d
    corner = lambda p: F.struct(F.col(p).alias("node"), F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"))
    spread = found.withColumn("_ux", ux).withColumn("_uy", uy).withColumn("n", F.explode(F.array(*map(corner, "abc"))))
    middle = lambda k: sum((F.col(f"{p}{k}") for p in "abc"), F.lit(0.0)) / 3
    turned = spread.withColumn("_t", F.atan2(middle("y") - F.col("n.y"), middle("x") - F.col("n.x"))).select(*keys, "n.node", "_t", "_ux", "_uy")
    rim = hull_edges(triangle_edges(found, keys), keys).select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct()
    ring, whole = Window.partitionBy(*keys, "node").orderBy("_t"), Window.partitionBy(*keys, "node").orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    shoelace = F.col("_ux") * F.col("_ny") - F.col("_nx") * F.col("_uy")
    return turned.join(rim, [*keys, "node"], "left_anti").withColumn("_nx", following("_ux")).withColumn("_ny", following("_uy")).groupBy(*keys, "node").agg((F.abs(F.sum(shoelace)) / 2).alias("area"))


def diffuse(edges: DataFrame, values: DataFrame, keys: list[str], columns: list[str], alpha: float = 0.9, rounds: int = 150, node: str = "node") -> DataFrame:
    """Spread values over weighted edges: the fixed point of X = alpha A X + (1 - alpha) P, A the weights over the sum of a node's column.

    Edges and nodes of a layer meet in one group, which an image bounds, and are iterated there as a list of
    edges: memory grows with them, not with the square of the nodes. The error falls by ``alpha`` a round.
    Nodes without edges keep (1 - alpha) P; edges of unknown nodes, or without positive weight, do not count.
    """
    types = {f.name: f.dataType.simpleString() for f in values.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in [*keys, node]), *(f"`{c}` double" for c in columns)])

    def run(_: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.drop_duplicates(node, ignore_index=True)
        start = nodes[columns].fillna(0.0).to_numpy(dtype=float) * (1 - alpha)
        index = pd.Index(nodes[node])
        i, j = index.get_indexer(links["src"]), index.get_indexer(links["dst"])
        w = links["weight"].to_numpy(dtype=float)
        good = (i >= 0) & (j >= 0) & (w > 0)
        both = pd.DataFrame({"i": np.r_[i[good], j[good]], "j": np.r_[j[good], i[good]], "w": np.r_[w[good], w[good]]}).groupby(["i", "j"], as_index=False).max()
        i, j = both["i"].to_numpy(dtype=int), both["j"].to_numpy(dtype=int)
        share = both["w"].to_numpy() / np.bincount(j, both["w"], len(nodes))[j]
        now = start
        for _ in range(rounds):
            now = start + alpha * np.column_stack([np.bincount(i, share * now[j, c], len(nodes)) for c in range(len(columns))])
        return nodes[[*keys, node]].assign(**dict(zip(columns, now.T, strict=True)))

    links_by_layer = spread(edges.select(*keys, "src", "dst", "weight"), keys).groupBy(*keys)
    return spread(values.select(*keys, node, *columns), keys).groupBy(*keys).cogroup(links_by_layer).applyInPandas(run, schema)


def communities(edges: DataFrame, nodes: DataFrame, keys: list[str], node: str = "node", most: int = 300) -> DataFrame:
    """Communities by weighted label propagation on joins: each round a node takes the label of most edge weight around it, ties to the least.

    A node holds on to its label with the weight of its strongest edge, and after eight rounds a random half
    of the nodes that want to move do so a round, which keeps neighbours from swapping for ever. It ends
    when no node wants to move; if some still do after ``most`` rounds that is an error. Labels are written to
    the shared folder each round. Nodes without edges stay alone. This stands for map-equation
    communities, whose exact result depends on a random search.
    """
    both = edges.select(*keys, "src", "dst", "weight").unionByName(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).filter("weight > 0 and src <> dst")
    links = both.groupBy(*keys, "src", "dst").agg(F.max("weight").alias("weight"))
    holds = links.groupBy(*keys, "src").agg((F.max("weight") * 0.999).alias("weight")).select(*keys, "src", F.col("src").alias("dst"), "weight")
    links = cut(links.unionByName(holds), "links")
    now = nodes.select(*keys, F.col(node).cast("bigint").alias(node), F.col(node).cast("bigint").alias("community"))
    for turn in range(most):
        votes = links.join(now.withColumnRenamed(node, "dst"), [*keys, "dst"]).groupBy(*keys, "src", "community").agg(F.round(F.sum("weight"), 9).alias("_w"))
        best = votes.groupBy(*keys, F.col("src").alias(node)).agg(F.max_by("community", F.struct("_w", (-F.col("community")).alias("l"))).alias("_best"))
        wanted = now.join(best, [*keys, node], "left").withColumn("_wants", F.coalesce(F.col("_best") != F.col("community"), F.lit(False)))
        goes = F.col("_wants") if turn < 8 else F.col("_wants") & (F.pmod(F.xxhash64(node, F.lit(turn)), F.lit(2)) == 0)
        seen = Observation()
        moved = wanted.withColumn("community", F.when(goes, F.col("_best")).otherwise(F.col("community")))
        now = cut(moved.observe(seen, F.count(F.when(F.col("_wants"), 1)).alias("open")).select(*keys, node, "community"), "communities")
        if not seen.get["open"]:
            return now
    raise RuntimeError(f"{seen.get['open']} nodes still change their community after {most} rounds")


def _mixed(node: np.ndarray, turn: int) -> np.ndarray:
    """Spark's xxhash64(node, turn) of a bigint and an int, as unsigned."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def end(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8)
        h = end(turned(h ^ (turned(node.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
        return end(turned((h + p5 + np.uint64(4)) ^ (np.uint64(turn) * p1), 23) * p2 + p3)


def settled(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """Communities of one layer: the rounds of :func:`communities` on distinct ``nodes`` and links listed in both directions, each once."""
    now, order = nodes.copy(), np.argsort(src, kind="stable")
    src, dst, weight = src[order], dst[order], weight[order]
    index = np.argsort(nodes, kind="stable")
    place = lambda of: index[np.searchsorted(nodes, of, sorter=index)]
    i, j = place(src), place(dst)
    for turn in range(most):
        label = now[j]
        by = np.lexsort((label, i))
        first = np.flatnonzero(np.r_[True, (i[by][1:] != i[by][:-1]) | (label[by][1:] != label[by][:-1])]) if len(by) else by
        votes = np.round(np.add.reduceat(weight[by], first), 9) if len(by) else weight
        who, what = i[by][first], label[by][first]
        rank = np.lexsort((what, -votes, who))
        top = rank[np.r_[True, who[rank][1:] != who[rank][:-1]]] if len(rank) else rank
        best = now.copy()
        best[who[top]] = what[top]
        wants = best != now
        if not wants.any():
            return now
        goes = wants if turn < 8 else wants & (_mixed(nodes, turn) % np.uint64(2) == 0)
        now = np.where(goes, best, now)
    raise RuntimeError(f"{wants.sum()} nodes of a layer still change their community after {most} rounds")


def layer_communities(edges: DataFrame, nodes: DataFrame, keys: list[str], node: str = "node", most: int = 300) -> DataFrame:
    """:func:`communities` where a group is one image: its edges and nodes meet in one group and settle there, in rounds of their own.

    The same rounds give the same communities; a layer that has settled no longer waits for the others.
    """
    types = ", ".join(f"`{k}` {nodes.schema[k].dataType.simpleString()}" for k in keys)

    def run(_: tuple, members: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        known = members[node].notna()
        ids = members.loc[known, node].drop_duplicates().to_numpy(dtype=np.int64)
        ends = links[["src", "dst", "weight"]].dropna()
        ends = ends[(ends["weight"] > 0) & (ends["src"] != ends["dst"])]
        both = pd.concat([ends, ends.rename(columns={"src": "dst", "dst": "src"})]).groupby(["src", "dst"], as_index=False)["weight"].max()
        holds = (both.groupby("src", as_index=False)["weight"].max()).assign(dst=lambda x: x["src"], weight=lambda x: x["weight"] * 0.999)
        both = pd.concat([both, holds])
        both = both[both["src"].isin(ids) & both["dst"].isin(ids)]
        found = dict(zip(ids.tolist(), settled(ids, both["src"].to_numpy(dtype=np.int64), both["dst"].to_numpy(dtype=np.int64), both["weight"].to_numpy(dtype=float), most).tolist(), strict=True))
        return members[[*keys, node]].assign(community=members[node].map(found))

    links_by_layer = spread(edges.select(*keys, "src", "dst", "weight"), keys).groupBy(*keys)
    used = nodes.select(*keys, F.col(node).cast("bigint").alias(node))
    return spread(used, keys).groupBy(*keys).cogroup(links_by_layer).applyInPandas(run, f"{types}, `{node}` bigint, community bigint")


def subgraph(edges: DataFrame, nodes: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """The edges whose two ends are both among ``nodes``. Nulls are no end; repeated nodes do not repeat edges."""
    end = lambda s: nodes.select(*keys, F.col(node).alias(s))
    return edges.join(end("src"), [*keys, "src"], "left_semi").join(end("dst"), [*keys, "dst"], "left_semi").select(*edges.columns)


def inside_outline(points: DataFrame, outline: DataFrame, keys: list[str], node: str = "node", height: float = 32.0) -> DataFrame:
    """Add ``inside``: whether a point (x, y) lies within the outline of its group, by counting the outline's edges to its right.

    ``outline``: keys and x1, y1, x2, y2 of each edge, in any order, of any number of rings (see :func:`alpha_edges` and
    :func:`edge_points`). Points and edges meet in stripes of ``height`` along y, so a point is compared with
    the edges beside it only. Points of null place, and of groups without an outline, are not inside.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    stripes = outline.filter("y1 <> y2").withColumn("_stripe", F.explode(F.sequence(F.floor(low / height), F.floor(high / height))))
    placed = points.select(*keys, node, "x", "y", F.floor(F.col("y") / height).alias("_stripe"))
    right = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    crossed = placed.join(stripes, [*keys, "_stripe"]).filter(right).groupBy(*keys, node).agg((F.count("*") % 2 == 1).alias("_in"))
    return points.drop("inside").join(crossed, [*keys, node], "left").withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_in")


def edge_points(edges: DataFrame, cells: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """Edges with the places of their ends: x1, y1, x2, y2."""
    place = F.struct("x", "y")
    ends = with_attribute(edges, cells.select(*keys, node, place.alias("_p")), keys, "_p", node)
    return ends.select(*edges.columns, F.col("_p_src.x").alias("x1"), F.col("_p_src.y").alias("y1"), F.col("_p_dst.x").alias("x2"), F.col("_p_dst.y").alias("y2"))


def label_shapes(found: DataFrame, cells: DataFrame, keys: list[str], label: str, alpha: float, node: str = "node") -> DataFrame:
    """Outlines per label: the edges around the triangles of one label whose circumradius is under ``alpha``; keys, label, src, dst, length."""
    own = triangle_labels(found, cells, keys, label, node).filter("label is not null")
    return alpha_edges(own, [*keys, "label"], alpha)
