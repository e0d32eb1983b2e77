"""Strict JSON expressions on Spark's VARIANT type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that stands in the plan, and is computed, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strict_object(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON object, else null.

    Spark's parser stops after the first value, so the text is parsed as the only element of an array:
    anything behind the object makes that array invalid or longer.
    """
    inner = stripped(text)
    parsed = bound(F.try_parse_json(F.concat(F.lit("["), inner, F.lit("]"))), lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))
    return F.when(inner.startswith("{") & inner.endswith("}"), parsed)


def with_object(df: DataFrame, text: str, name: str) -> DataFrame:
    """The rows whose ``text`` is exactly one JSON object, with its VARIANT as ``name``.

    The value comes out of a generator, below which the filter can't be pushed: there it would parse each text
    a second time. The outer form keeps Spark from inferring such a filter itself.
    """
    return df.select("*", F.explode_outer(F.array(strict_object(F.col(text)))).alias(name)).filter(F.col(name).isNotNull())


def stripped(text: Column) -> Column:
    """``text`` without the white space of JSON at both ends."""
    return F.btrim(text, F.lit(" \t\r\n"))


def number(text: Column) -> Column:
    """BIGINT of a text that holds a whole number in any spelling (``7``, ``7.0``, ``7e0``), else null."""
    exact = F.trim(text).try_cast("decimal(38,6)")
    return F.coalesce(text.try_cast("bigint"), F.when(exact == F.floor(exact), exact.try_cast("bigint")))
