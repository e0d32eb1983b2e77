"""Comparison of a query with its SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    return v


def differences(spark, data, query, sql):
    db = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = db.sql(sql)
    names = list(want.columns)
    df = query(spark, data)
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    expected = Counter(tuple(plain(v) for v in r) for r in want.fetchall())
    return list((got - expected).items())[:3], list((expected - got).items())[:3]
