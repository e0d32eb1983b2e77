"""References that point to nothing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut


@dataclass(frozen=True)
class Orphans:
    """``counts``: one row per orphan key and period with ``n_refs`` and ``heavy``, the side it was found on; ``rows``: the referring rows."""

    counts: DataFrame
    rows: DataFrame


def _same(left: str, right: str, key: list[str]):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}") == F.col(f"{right}.{c}") for c in key])


def orphan_references(refs: DataFrame, targets: DataFrame, key: list[str], period: str, most_heavy: int = 10_000, least: int = 4) -> Orphans:
    """Rows of ``refs`` whose ``key`` is in no row of ``targets``, and their number per key and period.

    References are first counted per key and period, which leaves one row of a hot key per period. Keys
    with more than 1/``most_heavy`` of all references, and at least ``least`` of them, are heavy; there are fewer than
    ``most_heavy`` of them whatever the data, so they are broadcast against the targets. All other keys
    take a shuffled anti join, and both results are united. Referring rows follow the same split, so a hot
    key's rows are never shuffled. Targets and light keys are never broadcast: Spark would judge them by the
    size of compressed files, of which lists of ids unpack to a hundred times as much in the driver.

    A null in any key column points to nothing, as in SQL. Repeated rows count each time; equal rows of
    targets count once. A null period is a period. Other columns of ``refs`` are kept, those of
    ``targets`` are not read. With no targets every reference is an orphan.
    """
    counts = cut(refs.groupBy(*key, period).agg(F.count("*").alias("n_refs")), "refs")
    per_key = counts.groupBy(*key).agg(F.sum("n_refs").alias("_n"))
    total = counts.agg(F.sum("n_refs")).first()[0] or 0
    heavy = F.broadcast(cut(per_key.filter((F.col("_n") > total / most_heavy) & (F.col("_n") >= least)).select(*key), "heavy"))
    targets = targets.select(*key).hint("merge")

    alive = targets.alias("t").join(heavy.alias("h"), _same("t", "h", key), "left_semi").distinct()
    light_counts = counts.alias("c").join(heavy.alias("h"), _same("c", "h", key), "left_anti")
    heavy_counts = counts.alias("c").join(heavy.alias("h"), _same("c", "h", key), "left_semi")
    light = light_counts.alias("c").join(targets.alias("t"), _same("c", "t", key), "left_anti")
    dead = heavy.alias("h").join(alive.alias("a"), _same("h", "a", key), "left_anti")
    orphan = cut(
        light.withColumn("_heavy", F.lit(False)).unionByName(heavy_counts.alias("c").join(F.broadcast(dead).alias("d"), _same("c", "d", key), "left_semi").withColumn("_heavy", F.lit(True))),
        "orphans",
    )
    light_keys = orphan.filter(~F.col("_heavy")).select(*key).distinct().hint("merge")
    heavy_keys = F.broadcast(orphan.filter("_heavy").select(*key).distinct())
    rest = refs.alias("r").join(heavy.alias("h"), _same("r", "h", key), "left_anti")
    none = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    rows = (
        rest.filter(~none).alias("r").join(light_keys.alias("k"), _same("r", "k", key), "left_semi")
        .unionByName(rest.filter(none))
        .unionByName(refs.alias("r").join(heavy_keys.alias("k"), _same("r", "k", key), "left_semi"))
    )
    return Orphans(orphan.withColumnRenamed("_heavy", "heavy"), rows)
