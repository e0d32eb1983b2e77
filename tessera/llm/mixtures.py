"""A mix of sources with target shares of the total size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Steps between 0 and 1 in which the ranks of a source's documents are counted.
STEPS = 4096


def source_name(source: Column) -> Column:
    """Names that differ only in case or outer blanks are one source."""
    return F.lower(F.trim(F.regexp_replace(source, r"^\s+|\s+$", "")))


@dataclass(frozen=True)
class Mix:
    """``chosen``: doc_id, source, tokens, copies (at least 1); ``report``: one row per source of the targets.

    ``below`` of the report is read off the drawn mix: the source stays under its target although each of its documents is in
    it max_repeats times.
    """

    chosen: DataFrame
    report: DataFrame


def targets_by_source(targets: DataFrame) -> DataFrame:
    """source, share, max_repeats. Spellings of a source add their weights; its largest max_repeats holds.

    Targets without a name, and weights that are null, NaN or not positive, do not count; a null or
    negative max_repeats is 0.
    """
    named = targets.select(source_name(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    summed = named.filter("source is not null and weight > 0 and not isnan(weight)").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    return summed.select("source", (F.col("weight") / F.sum("weight").over(Window.partitionBy())).alias("share"), "max_repeats")


def mix(sizes: DataFrame, targets: DataFrame, length_power: float = 0.5, seed: int = 17) -> Mix:
    """Choose documents so that each source has its share of a mix as large as all documents together.

    ``sizes``: doc_id, source, tokens; ``targets``: source, weight, max_repeats. A document's expected
    copies are proportional to tokens ** ``length_power`` within its source, at most max_repeats, and sum
    to the source's target in tokens; the factor is found per source by raising it until the capped
    documents no longer change, which each round but the last adds to. Whole copies are certain. The fractions are inclusion probabilities p of
    one more copy, drawn as a Pareto order sample: a hash gives u in (0, 1), documents are ranked by
    (u / (1 - u)) / (p / (1 - p)), and the first n, the rounded sum of p, are taken. A source without
    enough text has all its documents max_repeats times and stays below its share.

    The n-th rank is found from counts of ranks in steps; only documents within one step are put in
    order, so a source that holds most rows is not gathered. Documents whose source is null or has no
    target are not chosen but count in the size of the mix; null or non-positive sizes are not chosen.
    Targets are a small configuration table. An empty ``sizes`` gives a report of zeros.
    """
    docs = cut(sizes.select("doc_id", source_name(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens")).withColumn("w", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(length_power)))), "sizes")
    total = docs.agg(F.sum("tokens")).first()[0] or 0
    goal = targets_by_source(targets).withColumn("target_tokens", F.col("share") * F.lit(total))
    held = docs.filter("w is not null").groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("documents"), F.sum(F.col("w") * F.col("tokens")).alias("_wx"))
    plan = goal.join(held, "source", "left").fillna(0, ["source_tokens", "documents"]).withColumn("capacity_tokens", F.col("source_tokens") * F.col("max_repeats"))
    plan = cut(plan.withColumn("below", F.col("capacity_tokens") < F.col("target_tokens")).withColumn("factor", F.when(~F.col("below"), F.col("target_tokens") / F.col("_wx"))), "plan")
    drawn = docs.filter("w is not null")
    moved = 1
    while moved:
        capped = F.col("w") * F.col("factor") >= F.col("max_repeats")
        sums = drawn.join(plan.filter("not below").select("source", "factor", "max_repeats"), "source").groupBy("source").agg(
            F.sum(F.when(capped, F.col("tokens")).otherwise(0)).alias("_full"), F.sum(F.when(~capped, F.col("w") * F.col("tokens"))).alias("_open")
        )
        better = plan.join(sums, "source", "left").withColumn("_next", F.when(F.col("_open") > 0, (F.col("target_tokens") - F.col("_full") * F.col("max_repeats")) / F.col("_open")).otherwise(F.col("factor")))
        after = cut(better.withColumn("_moved", F.col("_next") > F.col("factor") * (1 + 1e-12)).withColumn("factor", F.greatest("factor", "_next")).select(*plan.columns, "_moved"), "plan")
        moved = after.filter("_moved").limit(1).count()
        plan = after.drop("_moved")
    expected = F.when(F.col("below"), F.col("max_repeats").cast("double")).otherwise(F.least(F.col("max_repeats").cast("double"), F.col("w") * F.col("factor")))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    copies = drawn.join(plan.select("source", "below", "factor", "max_repeats"), "source").withColumn("_e", expected).withColumn("whole", F.floor(F.col("_e") + 1e-9)).withColumn("p", F.greatest(F.col("_e") - F.col("whole"), F.lit(0.0)))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = cut(copies.withColumn("u", u).withColumn("q", F.when(F.col("p") > 1e-9, odds)).select("doc_id", "source", "tokens", "whole", "p", "q", F.floor(F.col("q") / (1 + F.col("q")) * STEPS).alias("step")), "ranked")

    steps = ranked.filter("q is not null").groupBy("source", "step").agg(F.count("*").alias("c"), F.sum("p").alias("p"))
    until = Window.partitionBy("source").orderBy("step")
    reach = steps.withColumn("upto", F.sum("c").over(until)).withColumn("n", F.round(F.sum("p").over(Window.partitionBy("source"))))
    edge = reach.filter("upto >= n and upto - c < n").select("source", F.col("step").alias("edge"), (F.col("n") - F.col("upto") + F.col("c")).alias("wanted"))
    placed = ranked.join(edge, "source", "left")
    inside = placed.filter("step = edge").withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy("q", "doc_id"))).withColumn("extra", (F.col("_k") <= F.col("wanted")).cast("int")).drop("_k")
    others = placed.filter("step is null or edge is null or step <> edge").withColumn("extra", F.coalesce((F.col("step") < F.col("edge")).cast("int"), F.lit(0)))
    chosen = cut(inside.unionByName(others).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int")).filter("copies > 0").select("doc_id", "source", "tokens", "copies"), "chosen")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("documents_used"), F.max("copies").alias("most_copies"))
    report = plan.select("source", "share", "max_repeats", "documents", "source_tokens", "target_tokens", "capacity_tokens").join(got, "source", "left").fillna(0, ["mixed_tokens", "documents_used", "most_copies"])
    used_up = (F.col("mixed_tokens") < F.col("target_tokens")) & (F.col("documents_used") == F.col("documents")) & (F.col("mixed_tokens") == F.col("capacity_tokens"))
    report = report.withColumn("below", used_up)
    return Mix(chosen, report.withColumn("mixed_share", F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(Window.partitionBy()), F.lit(0))))
