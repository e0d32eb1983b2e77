"""Gaussian mixtures of (log) values, labels from them, and annotation with spatial context."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.json import bound
from tessera.operators import graphs
from tessera.operators.ordering import running_totals
from tessera.session import cut


@dataclass(frozen=True)
class Mixture:
    """Weights, means and diagonal variances of components, in the log domain if ``log``; components ordered by first mean."""

    weights: tuple[float, ...]
    means: tuple[tuple[float, ...], ...]
    variances: tuple[tuple[float, ...], ...]
    log_likelihood: float = float("nan")
    rows: int = 0
    log: bool = True

    @property
    def parameters(self) -> int:
        k, d = len(self.weights), len(self.means[0])
        return 2 * k * d + k - 1

    @property
    def bic(self) -> float:
        return self.parameters * math.log(max(1, self.rows)) - 2 * self.log_likelihood

    @property
    def aic(self) -> float:
        return 2 * self.parameters - 2 * self.log_likelihood

    def marginal(self, dimension: int) -> Mixture:
        """The mixture of one dimension."""
        return Mixture(self.weights, tuple((m[dimension],) for m in self.means), tuple((v[dimension],) for v in self.variances), log=self.log)


def domain(columns: list[str], log: bool) -> list[Column]:
    """The columns a mixture sees: their logarithms if ``log``, null where there is none."""
    return [F.when(F.col(c) > 0, F.ln(c)) if log else F.col(c).cast("double") for c in columns]


def component_densities(mixture: Mixture, columns: list[Column]) -> list[Column]:
    """Weight times density of each component, as expressions."""
    out = []
    for w, mean, var in zip(mixture.weights, mixture.means, mixture.variances, strict=True):
        exponent = sum((F.pow(c - F.lit(m), F.lit(2.0)) / F.lit(2 * v) for c, m, v in zip(columns, mean, var, strict=True)), F.lit(0.0))
        scale = w / math.prod(math.sqrt(2 * math.pi * v) for v in var)
        out.append(F.lit(scale) * F.exp(-exponent))
    return out


def responsibilities(mixture: Mixture, columns: list[Column]) -> Column:
    """ARRAY<DOUBLE> of the components' shares in a value's density, from log densities less their maximum; null where a column is null."""
    logs = []
    for w, mean, var in zip(mixture.weights, mixture.means, mixture.variances, strict=True):
        scale = math.log(w) - 0.5 * sum(math.log(2 * math.pi * v) for v in var)
        logs.append(F.lit(scale) - sum((F.pow(c - F.lit(m), F.lit(2.0)) / F.lit(2 * v) for c, m, v in zip(columns, mean, var, strict=True)), F.lit(0.0)))
    known = columns[0].isNotNull()
    for c in columns[1:]:
        known = known & c.isNotNull()
    parts = bound(F.array(*logs), lambda x: F.transform(x, lambda y: F.exp(y - F.array_max(x))))
    return F.when(known, bound(parts, lambda x: F.transform(x, lambda y: y / F.aggregate(x, F.lit(0.0), lambda a, z: a + z))))


def _sums(model: Mixture, values: np.ndarray, counts: np.ndarray) -> tuple[float, list, list, list]:
    """Log-likelihood of counted values, and each component's share of rows, of values and of their squares.

    Shares come from log densities less their maximum, so a value far from all components still has a full share.
    """
    means, variances = np.array(model.means), np.array(model.variances)
    logs = np.log(model.weights) - 0.5 * np.log(2 * np.pi * variances).sum(axis=1) - sum((values[:, d, None] - means[:, d]) ** 2 / (2 * variances[:, d]) for d in range(values.shape[1]))
    top = logs.max(axis=1, keepdims=True)
    r = np.exp(logs - top)
    total = r.sum(axis=1, keepdims=True)
    r *= counts[:, None] / total
    return float((top[:, 0] + np.log(total[:, 0])) @ counts), r.sum(axis=0).tolist(), (r.T @ values).tolist(), (r.T @ values**2).tolist()


def _flat(sums: tuple[float, list, list, list]) -> np.ndarray:
    return np.concatenate([np.ravel(x) for x in sums])


def _shaped(flat: np.ndarray, k: int, d: int) -> tuple[float, list, list, list]:
    """The inverse of :func:`_flat` for ``k`` components of ``d`` dimensions."""
    at = 1 + k + k * d
    return float(flat[0]), flat[1 : 1 + k].tolist(), flat[1 + k : at].reshape(k, d).tolist(), flat[at:].reshape(k, d).tolist()


def _moved(model: Mixture, sums: tuple[float, list, list, list], n: int, least_variance: float) -> Mixture:
    """The mixture that a round's sums give."""
    likelihood, sizes, firsts, seconds = sums
    weights, means, variances = [], [], []
    for j in range(len(sizes)):
        kept = sizes[j] > 1e-9
        middle = tuple(x / sizes[j] for x in firsts[j]) if kept else model.means[j]
        weights.append(max(sizes[j] / n, 1e-12))
        means.append(middle)
        variances.append(tuple(max(y / sizes[j] - m * m, least_variance) for y, m in zip(seconds[j], middle, strict=True)) if kept else model.variances[j])
    order = sorted(range(len(sizes)), key=lambda j: means[j])
    return Mixture(tuple(weights[j] for j in order), tuple(means[j] for j in order), tuple(variances[j] for j in order), likelihood, n, model.log)


def fit_each(rows: DataFrame, columns: list[str], counts: list[int], log: bool = True, rounds: int = 100, tolerance: float = 1e-6, least_variance: float = 1e-6, step: float = 1e-3) -> list[Mixture]:
    """Expectation-maximisation on the counts of values rounded to ``step`` (0: not rounded), for each number of components in ``counts``.

    Counting is one aggregate that combines before its shuffle and makes one dimension a few thousand rows
    whatever the input. The counts stay a table, and each round is one pass over it for all mixtures that
    still move: tasks send their sums (see :func:`_sums`), only parameters are held here. Starts from evenly spaced percentiles of the first column's counted values, so results do
    not depend on a seed. Rows with a null (or, for logarithms, a value that is not positive) do not count.
    At most ``rounds`` rounds, until the mean log-likelihood gains less than ``tolerance``. Components that
    lose all rows keep their place with no weight. Raises ValueError without rows.
    """
    names = [f"v{i}" for i in range(len(columns))]
    data = rows.select(*[(F.round(c / step) * step if step else c).alias(n) for n, c in zip(names, domain(columns, log), strict=True)]).dropna()
    data = cut(data.groupBy(*names).agg(F.count("*").alias("_n")), "sample")
    moments = [s for c in names for s in ((F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(f"m_{c}"), (F.sum(F.col("_n") * F.col(c) * F.col(c)) / F.sum("_n")).alias(f"q_{c}"))]
    first = data.agg(F.count("*").alias("size"), F.sum("_n").alias("n"), *moments).first()
    n, size = first["n"], first["size"]
    if not size:
        raise ValueError("there are no rows to fit")
    ranks = sorted({max(1, math.ceil((i + 0.5) / k * n)) for k in counts for i in range(k)})
    totals = running_totals(data.groupBy("v0").agg(F.sum("_n").alias("_n")), [], ["v0"], ["_n"])
    hit = totals.withColumn("_at", F.explode(F.array(*map(F.lit, ranks)))).filter("_n_upto >= _at and _n_upto - _n < _at")
    starts = {r["_at"]: r["v0"] for r in hit.select("_at", "v0").collect()}
    spread = [first[f"q_{c}"] - first[f"m_{c}"] ** 2 for c in names]
    models = []
    for k in counts:
        var = tuple(max(float(s) / (k * k if d == 0 else 1), least_variance) for d, s in enumerate(spread))
        others = tuple(float(first[f"m_{c}"]) for c in names[1:])
        models.append(Mixture((1 / k,) * k, tuple((float(starts[max(1, math.ceil((i + 0.5) / k * n))]), *others) for i in range(k)), (var,) * k, log=log))

    def passed(at: list[int]) -> list[tuple[float, list, list, list]]:
        now = [models[i] for i in at]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                part = np.concatenate([_flat(_sums(m, table[:, :-1], table[:, -1])) for m in now])
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        flat = sum(np.array(r[0]) for r in data.select(*names, "_n").mapInArrow(partial, "sums array<double>").collect())
        ends = np.cumsum([1 + len(m.weights) * (1 + 2 * len(names)) for m in now])[:-1]
        return [_shaped(x, len(m.weights), len(names)) for x, m in zip(np.split(flat, ends), now, strict=True)]

    moving, before = list(range(len(models))), [-math.inf] * len(models)
    for _ in range(rounds):
        for i, sums in zip(moving, passed(moving), strict=True):
            models[i] = _moved(models[i], sums, n, least_variance)
        gains = {i: models[i].log_likelihood - before[i] for i in moving}
        moving = [i for i in moving if gains[i] >= tolerance * n]
        for i in moving:
            before[i] = models[i].log_likelihood
        if not moving:
            break
    return models


def fit(rows: DataFrame, columns: list[str], k: int, **settings: object) -> Mixture:
    """The mixture of ``k`` components, see :func:`fit_each`."""
    return fit_each(rows, columns, [k], **settings)[0]


def select(rows: DataFrame, columns: list[str], least: int = 3, most: int = 10, criterion: str = "bic", log: bool = True) -> tuple[Mixture, list[Mixture]]:
    """The mixture of ``least`` to ``most`` components with the least BIC (or AIC), and all of them."""
    models = fit_each(rows, columns, list(range(least, most + 1)), log)
    return min(models, key=lambda m: getattr(m, criterion)), models


def component_labels(mixture: Mixture, labels: int) -> list[int]:
    """Label of each component: their means (of the values, not logarithms) in the contiguous grouping of least squared spread, by the first dimension.

    Exact: all contiguous groupings of the few ordered components are compared.
    """
    values = [math.exp(m[0]) if mixture.log else m[0] for m in mixture.means]
    k = len(values)
    labels = min(labels, k)
    spread = lambda part: sum((v - sum(part) / len(part)) ** 2 for v in part)
    best = min(itertools.combinations(range(1, k), labels - 1), key=lambda cuts: sum(spread(values[a:b]) for a, b in itertools.pairwise((0, *cuts, k))))
    return [sum(c <= i for c in best) for i in range(k)]


def posterior(mixture: Mixture, columns: list[Column], labels: int) -> Column:
    """ARRAY<DOUBLE>: probability of each label, the components' shares summed; outside all components the outermost label is sure.

    Outside means under or over every component's mean by more than 4 deviations in the first dimension,
    where densities vanish and shares would be noise.
    """
    of = component_labels(mixture, labels)
    r = responsibilities(mixture, columns)
    by_label = bound(r, lambda shares: F.array(*[sum((shares[i] for i, x in enumerate(of) if x == label), F.lit(0.0)) for label in range(labels)]))
    low = min(m[0] - 4 * math.sqrt(v[0]) for m, v in zip(mixture.means, mixture.variances, strict=True))
    high = max(m[0] + 4 * math.sqrt(v[0]) for m, v in zip(mixture.means, mixture.variances, strict=True))
    sure = lambda at: F.array(*[F.lit(float(i == at)) for i in range(labels)])
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return F.when(known, F.when(columns[0] < low, sure(0)).when(columns[0] > high, sure(labels - 1)).otherwise(by_label))


def most_probable(probabilities: Column) -> Column:
    """Position of the largest probability, the first of ties; null for null."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def combined(marginal: Column, bivariate: Column, threshold: float = 0.8) -> Column:
    """The marginal posterior, but the bivariate one where only that exceeds ``threshold``."""
    return F.when((F.array_max(bivariate) > threshold) & (F.array_max(marginal) < threshold), bivariate).otherwise(marginal)


def annotate(cells: DataFrame, edges: DataFrame, keys: list[str], attribute: str, labels: int = 3, components: int | None = None, alpha: float = 0.9, threshold: float = 0.8, node: str = "node") -> DataFrame:
    """Label cells by attribute and surroundings: cells with ``label`` and ``probability``.

    The attribute and its geometric mean over neighbours are modelled together and alone; posteriors of the
    two models are combined and diffused over weighted edges, and the most probable label is taken. Either
    model has ``components`` components, or the number that :func:`select` takes for it. Cells without a
    positive attribute have no label of their own but may get one from neighbours.
    """
    pairs = graphs.neighbours(edges, keys, 1)
    sampled = cut(graphs.neighbour_means(pairs, cells, keys, attribute, node=node), "sampled")
    around = f"{attribute}_sampled"
    used = sampled.filter("neighbours > 0")
    both, alone = (select(used, columns)[0] if components is None else fit(used, columns, components) for columns in ([attribute, around], [attribute]))
    p = combined(posterior(alone, domain([attribute], True), labels), posterior(both, domain([attribute, around], True), labels), threshold)
    none = F.array(*[F.lit(0.0)] * labels)
    columns = [f"p{i}" for i in range(labels)]
    split = sampled.withColumn("_p", F.coalesce(p, none)).select(*keys, node, *[F.col("_p")[i].alias(c) for i, c in enumerate(columns)])
    weighted = graphs.edge_weights(graphs.undirected(edges, keys), cells, keys, attribute, node=node).filter("weight is not null")
    spread = graphs.diffuse(weighted, split, keys, columns, alpha, node=node)
    array = F.array(*columns)
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    done = spread.select(*keys, node, F.when(total > 0, most_probable(array)).alias("label"), (F.array_max(array) / F.nullif(total, F.lit(0.0))).alias("probability"))
    return cells.drop("label", "probability").join(done, [*keys, node], "left")


#: Ways to label cells that :func:`annotations` tells apart.
METHODS = ("level", "bivariate", "combined", "community")


def annotations(cells: DataFrame, edges: DataFrame, keys: list[str], attribute: str, alone: Mixture, both: Mixture, methods: tuple[str, ...] = METHODS, labels: int = 3, alpha: float = 0.9, threshold: float = 0.8, node: str = "node") -> DataFrame:
    """Each cell once per method with the label it gives: the cells' columns, method, predicted.

    ``level`` takes the posterior of the attribute by the model ``alone``, ``bivariate`` that of attribute and neighbours' mean by
    ``both``, ``combined`` either by confidence, ``community`` what is left after diffusion of the combined one over weighted
    edges. Replicates are keys like any other, so a benchmark over all of them is one plan. A cell without a
    positive attribute has a label by ``community`` at most.
    """
    sampled = graphs.neighbour_means(graphs.neighbours(edges, keys, 1), cells, keys, attribute, node=node)
    one = posterior(alone, domain([attribute], True), labels)
    two = posterior(both, domain([attribute, f"{attribute}_sampled"], True), labels)
    columns = cells.columns
    held = cut(sampled.withColumn("_one", one).withColumn("_two", two).withColumn("_c", combined(F.col("_one"), F.col("_two"), threshold)), "annotations")
    parts = [held.select(*columns, F.lit(m).alias("method"), most_probable(F.col(c)).alias("predicted")) for m, c in zip(METHODS, ("_one", "_two", "_c"), strict=False) if m in methods]
    if "community" in methods:
        names = [f"p{i}" for i in range(labels)]
        none = F.array(*[F.lit(0.0)] * labels)
        split = held.select(*keys, node, *[F.coalesce("_c", none)[i].alias(c) for i, c in enumerate(names)])
        weighted = graphs.edge_weights(graphs.undirected(edges, keys), cells, keys, attribute, node=node).filter("weight is not null")
        spread = graphs.diffuse(weighted, split, keys, names, alpha, node=node)
        label = F.when(F.array_max(F.array(*names)) > 0, most_probable(F.array(*names)))
        parts.append(cells.join(spread.select(*keys, node, label.alias("predicted")), [*keys, node], "left").select(*columns, F.lit("community").alias("method"), "predicted"))
    return reduce(DataFrame.unionByName, parts)


def sample(mixture: Mixture, spark, rows: int, seed: int = 1) -> DataFrame:
    """Draw ``rows`` synthetic rows: component and v0, v1, ... (not logarithms if the mixture is of logarithms)."""
    base = spark.range(rows).withColumn("_u", F.rand(seed))
    component, upto = F.lit(len(mixture.weights) - 1), 0.0
    cases = []
    for j, w in enumerate(mixture.weights[:-1]):
        upto += w
        cases.append((upto, j))
    for bound, j in reversed(cases):
        component = F.when(F.col("_u") < bound, j).otherwise(component)
    out = base.withColumn("component", component)
    pick = lambda table, d: F.element_at(F.array(*[F.lit(float(x[d])) for x in table]), F.col("component") + 1)
    for d in range(len(mixture.means[0])):
        value = pick(mixture.means, d) + F.sqrt(pick(mixture.variances, d)) * F.randn(seed + 1 + d)
        out = out.withColumn(f"v{d}", F.exp(value) if mixture.log else value)
    return out.drop("_u")


def required_samples(mixture: Mixture, ratio: float = 5.0) -> float:
    """Rows per mean so that every two components stand ``ratio`` errors apart: the largest (ratio * deviation / distance) squared."""
    pairs = itertools.combinations(range(len(mixture.weights)), 2)
    return max((ratio * max(math.sqrt(mixture.variances[i][0]), math.sqrt(mixture.variances[j][0])) / max(abs(mixture.means[i][0] - mixture.means[j][0]), 1e-12)) ** 2 for i, j in pairs)


def kmeans_labels(rows: DataFrame, columns: list[str], clusters: int, labels: int, log: bool = True, seed: int = 1) -> DataFrame:
    """Add ``label``: k-means clusters of the (log) columns in order of their first centre, grouped into ``labels`` contiguous labels.

    Rows with a null (or, for logarithms, a value that is not positive) get null.
    """
    names = [f"_v{i}" for i in range(len(columns))]
    seen = rows.withColumns(dict(zip(names, domain(columns, log), strict=True)))
    known = " and ".join(f"{n} is not null" for n in names)
    assembler = VectorAssembler(inputCols=names, outputCol="_features")
    model = KMeans(k=clusters, seed=seed, featuresCol="_features", predictionCol="_cluster").fit(assembler.transform(seen.filter(known)))
    centres = sorted(enumerate(model.clusterCenters()), key=lambda c: c[1][0])
    groups = component_labels(Mixture((1.0,) * len(centres), tuple((float(c[0]),) for _, c in centres), ((1.0,),) * len(centres), log=log), labels)
    label = F.create_map(*[F.lit(x) for (cluster, _), g in zip(centres, groups, strict=True) for x in (cluster, g)])
    done = model.transform(assembler.transform(seen.filter(known))).withColumn("label", label[F.col("_cluster")])
    return done.unionByName(seen.filter(f"not ({known})"), allowMissingColumns=True).drop(*names, "_features", "_cluster")


def density_threshold(rows: DataFrame, density: str, seed: int = 1) -> float:
    """Largest density of the lower of two k-means clusters of its decimal logarithm."""
    data = rows.filter(F.col(density) > 0).select(density, F.log10(density).alias("_l"))
    model = KMeans(k=2, seed=seed, featuresCol="_f", predictionCol="_c").fit(features := VectorAssembler(inputCols=["_l"], outputCol="_f").transform(data))
    low = min(range(2), key=lambda c: model.clusterCenters()[c][0])
    return float(model.transform(features).filter(F.col("_c") == low).agg(F.max(density)).first()[0])


def grid_mask(layers: DataFrame, height: int, width: int, value: Column, thresholds: list[float]) -> DataFrame:
    """Bins of an expression of x and y (from 0 to 1) over a pixel grid of each layer: row, col, bin (how many thresholds it reaches)."""
    grid = layers.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    placed = grid.withColumn("x", F.col("col") / F.lit(max(1, width - 1))).withColumn("y", F.col("row") / F.lit(max(1, height - 1))).withColumn("_v", value)
    return placed.withColumn("bin", sum((F.when(F.col("_v") >= t, 1).otherwise(0) for t in thresholds), F.lit(0))).drop("x", "y", "_v")


def kernel_density(rows: DataFrame, keys: list[str], x: str, y: str, bandwidth: float, node: str = "node") -> DataFrame:
    """Add ``density``: mean Gaussian kernel of the layer's cells at each cell, summed over cells within four bandwidths by the grid join."""
    cells = rows.select(*keys, node, F.col(x).alias("x"), F.col(y).alias("y"))
    near = graphs.radius_neighbours(cells, keys, 4 * bandwidth, node)
    kernel = F.exp(-F.pow(F.col("distance") / bandwidth, F.lit(2.0)) / 2)
    sums = near.groupBy(*keys, F.col("node").alias(node)).agg(F.sum(kernel).alias("_s"))
    sizes = cells.groupBy(*keys).agg(F.count("*").alias("_n"))
    norm = 2 * math.pi * bandwidth * bandwidth
    return rows.join(sums, [*keys, node], "left").join(sizes, keys).withColumn("density", (F.coalesce("_s", F.lit(0.0)) + 1) / F.col("_n") / norm).drop("_s", "_n")


def multiquadric(points: np.ndarray, values: np.ndarray, smooth: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and scale of a smoothed multiquadric surface through ``values`` at ``points`` (control points, a bounded set)."""
    d = np.hypot(*(points[:, None, :] - points[None, :, :]).transpose(2, 0, 1))
    scale = float(d[d > 0].mean()) if (d > 0).any() else 1.0
    return np.linalg.solve(np.sqrt((d / scale) ** 2 + 1) - np.eye(len(points)) * smooth, values), scale


def surface(x: Column, y: Column, points: np.ndarray, weights: np.ndarray, scale: float) -> Column:
    """The surface of :func:`multiquadric` at a point, as an expression."""
    return sum((F.lit(float(w)) * F.sqrt((F.pow(x - F.lit(float(px)), F.lit(2.0)) + F.pow(y - F.lit(float(py)), F.lit(2.0))) / (scale * scale) + 1) for (px, py), w in zip(points, weights, strict=True)), F.lit(0.0))
