"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import clusters as markov
from tessera.llm import containers, languages, mixtures
from tessera.llm import percentiles as sketches
from tessera.llm.tokens import VOCABULARY, token_count
from tessera.session import cut, load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    done = markov.marker_clusters(markov.considered_cells(load(spark, d, "cell_measurements")))
    return markov.members(done, markov.separate_clusters(done)).select("cell_id", "genotype", "cluster_rank")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    done = markov.marker_clusters(markov.considered_cells(load(spark, d, "cell_measurements")))
    return markov.described(done, markov.separate_clusters(done))


PCTS = [10, 50, 90]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    values = cut(sketches.readings(load(spark, d, "cell_measurements").filter("stack is not null and layer is not null")).select("stack", "layer", "clonal_marker"), "readings")
    by_layer = cut(sketches.sketch(values, ["stack", "layer"], "clonal_marker"), "sketches")
    of_layer = sketches.percentiles(by_layer, ["stack", "layer"], PCTS)
    of_stack = sketches.percentiles(sketches.merge(by_layer, ["stack"]), ["stack"], PCTS)
    names = ["n", "value", "low", "high"]
    pairs = cut(
        of_layer.select("stack", "layer", "pct", *[F.col(c).alias(f"l_{c}") for c in names]).join(of_stack.select("stack", "pct", *[F.col(c).alias(f"s_{c}") for c in names]), ["stack", "pct"]),
        "percentiles",
    )
    apart = lambda a, b, c, e: (F.col(a) >= 2 * F.col(b)) | (F.col(c) <= F.col(e) / 2)
    sure = pairs.filter(apart("l_low", "s_high", "l_high", "s_low"))
    open_pairs = pairs.filter(apart("l_high", "s_low", "l_low", "s_high") & ~apart("l_low", "s_high", "l_high", "s_low"))
    bracket = lambda keys, p: open_pairs.select(*keys, "pct", *[F.col(f"{p}_{c}").alias(c) for c in ("n", "low", "high")]).distinct()
    layers = sketches.exact_percentiles(values, ["stack", "layer"], "clonal_marker", bracket(["stack", "layer"], "l"))
    stacks = sketches.exact_percentiles(values, ["stack"], "clonal_marker", bracket(["stack"], "s"))
    checked = layers.withColumnRenamed("value", "l").join(stacks.withColumnRenamed("value", "s"), ["stack", "pct"])
    return sure.select("stack", "layer", "pct").unionByName(checked.filter("l >= 2 * s or l <= s / 2").select("stack", "layer", "pct"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of stacks, from the layers' sketches, and of months, from the days' sketches, with their bounds."""
    values = cut(sketches.readings(load(spark, d, "cell_measurements")), "readings")
    by_stack = sketches.merge(sketches.sketch(values, ["stack", "layer"], "clonal_marker"), ["stack"])
    by_day = sketches.sketch(values, ["day"], "clonal_marker").withColumn("month", F.date_format("day", "yyyy-MM"))
    by_month = sketches.merge(by_day, ["month"])
    answer = lambda s, key: sketches.percentiles(s, [key], PCTS).select(F.lit(key).alias("grouping"), F.col(key).alias("grouped"), "n", "pct", "value", "low", "high", "rank_error")
    return answer(by_stack, "stack").unionByName(answer(by_month, "month"))


def _sizes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return cut(load(spark, d, "documents").select("doc_id", *columns, token_count(F.col("text"), VOCABULARY).alias("tokens")), "tokens")


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    """Container sizes by kind: a configuration table of a few rows."""
    return {r["bin_kind"]: r["capacity_tokens"] for r in load(spark, d, "pack_bins").filter("bin_kind is not null and capacity_tokens > 0").collect()}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return containers.split_texts(containers.pack(_sizes(spark, d), _capacities(spark, d)["long"]))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers.pack(_sizes(spark, d), _capacities(spark, d)["long"]).rows


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d)
    parts = [containers.report(containers.pack(sizes, c)).withColumn("bin_kind", F.lit(k)) for k, c in sorted(_capacities(spark, d).items())]
    return reduce(DataFrame.unionByName, parts)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixtures.mix(_sizes(spark, d, "source"), load(spark, d, "mix_targets")).report.filter("below").select("source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixtures.mix(_sizes(spark, d, "source"), load(spark, d, "mix_targets")).report


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixtures.mix(_sizes(spark, d, "source"), load(spark, d, "mix_targets")).chosen


def _languages(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, str]]:
    """Found languages, and the accepted spellings: a configuration table of a few dozen rows."""
    documents = load(spark, d, "documents")
    codes = {r["alias"]: r["lang_code"] for r in load(spark, d, "language_codes").filter("alias is not null").collect()}
    return languages.identify(documents, languages.fit(languages.training_sample(documents, codes))), codes


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.wrong_or_mixed(*_languages(spark, d)).select("doc_id", "cue_no", "lang").distinct()


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d)[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_clusters, p4_found, p4_percentiles, p7_found, p7_containers, p7_report, p8_found, p8_report, p8_mix, p9_found, p9_languages)}
READINGS = "r AS (SELECT cell_id, min(stack) AS stack, min(layer) AS layer, min(genotype) AS genotype, min(clonal_marker) AS m FROM cell_measurements WHERE clonal_marker > 0 AND clonal_marker < 1{} GROUP BY cell_id)"
#: Sizes in words, numbers and marks: a tokenizer that SQL can express. The cases of problems 7 and 8 are the same in any.
COUNTED = r"t AS (SELECT doc_id, lower(trim(source)) AS source, len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]')) AS n FROM documents)"
SQL: dict[str, str] = {
    "p7_found": f"WITH {COUNTED} SELECT doc_id FROM t WHERE n > (SELECT capacity_tokens FROM pack_bins WHERE bin_kind = 'long')",
    "p8_found": f"""WITH {COUNTED}, h AS (SELECT source, sum(n) AS n FROM t GROUP BY source), g AS (SELECT lower(trim(source)) AS source, sum(weight) AS weight, max(max_repeats) AS most FROM mix_targets WHERE weight > 0 GROUP BY ALL)
SELECT source FROM g LEFT JOIN h USING (source) WHERE coalesce(h.n, 0) * most < weight / (SELECT sum(weight) FROM g) * (SELECT sum(n) FROM t)""",
    "p1_found": f"""WITH {READINGS.format(" AND genotype IN (0, 1, 2)")}, g AS (SELECT cell_id, genotype, ln(m) AS x, CASE WHEN ln(m) - lag(ln(m)) OVER (PARTITION BY genotype ORDER BY m) <= 0.3 THEN 0 ELSE 1 END AS b FROM r),
h AS (SELECT *, sum(b) OVER (PARTITION BY genotype ORDER BY x ROWS UNBOUNDED PRECEDING) AS k, count(*) OVER (PARTITION BY genotype) AS t FROM g),
q AS (SELECT genotype, k, row_number() OVER (PARTITION BY genotype ORDER BY k)::INT AS cluster_rank FROM h GROUP BY genotype, k HAVING max(x) - min(x) <= 0.3 AND count(*) >= 0.01 * max(t)) SELECT cell_id, genotype, cluster_rank FROM h JOIN q USING (genotype, k)""",
    "p4_found": f"""WITH {READINGS.format("")}, a AS (SELECT stack, layer, m, row_number() OVER (PARTITION BY stack, layer ORDER BY m) AS rl, count(*) OVER (PARTITION BY stack, layer) AS nl, row_number() OVER (PARTITION BY stack ORDER BY m) AS rs, count(*) OVER (PARTITION BY stack) AS ns FROM r),
p AS (SELECT unnest([10, 50, 90]) AS pct), l AS (SELECT stack, layer, pct, m FROM a, p WHERE rl = ceil(pct * nl / 100.0)), s AS (SELECT stack, pct, m FROM a, p WHERE rs = ceil(pct * ns / 100.0))
SELECT l.stack, l.layer, l.pct FROM l JOIN s USING (stack, pct) WHERE l.m >= 2 * s.m OR l.m <= s.m / 2""",
}
