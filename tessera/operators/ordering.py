"""Neighbours in an order, without gathering a whole group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: ``value`` of the row before within ``keys`` in ``order``.

    Rows are range-partitioned by keys *and* order, so a group that holds most rows spreads over many
    chunks. Within a chunk a window finds the previous row; a chunk's first row gets the last value of
    the chunk before it from a table of one row per chunk and group.

    Null keys form a group of their own, nulls in ``order`` come first; the first row of a group, and
    every row of an empty table, has a null. ``value`` must not be null. ``order`` should be unique
    within ``keys``; rows that tie come in any order.
    """
    staged = cut(df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("_chunk", *keys).orderBy(*order)
    lasts = staged.groupBy("_chunk", *keys).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = lasts.select(*[F.col(c).alias(f"_c_{c}") for c in ("_chunk", *keys)], F.lag("_last").over(across).alias("_carried"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in ("_chunk", *keys)])
    out = staged.withColumn("_own", F.lag(value).over(inside)).join(carried, same, "left")
    return out.withColumn(name, F.coalesce("_own", "_carried")).select(*df.columns, name)


def running_totals(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Add ``{value}_upto`` and ``{value}_all``: sums up to and including each row within ``keys`` in ``order``, and over the group.

    Chunked as in :func:`with_previous`: a chunk adds the sums of the chunks before it, of which there is
    one row per chunk and group. ``order`` should be unique within ``keys``; a null value counts as 0.
    """
    staged = cut(df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("_chunk", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = staged.groupBy("_chunk", *keys).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"_s_{v}") for v in values])
    before, whole = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    carried = sums.select(
        *[F.col(c).alias(f"_c_{c}") for c in ("_chunk", *keys)],
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values], *[F.sum(f"_s_{v}").over(whole).alias(f"{v}_all") for v in values],
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in ("_chunk", *keys)])
    out = staged.withColumns({f"_o_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(carried, same)
    return out.select(*df.columns, *[(F.col(f"_o_{v}") + F.col(f"_b_{v}")).alias(f"{v}_upto") for v in values], *[f"{v}_all" for v in values])
