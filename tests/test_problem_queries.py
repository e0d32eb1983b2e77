"""The problem queries of the core against plain Python on whole small tables."""

import brute
import pyarrow.parquet as pq
import pytest

from tessera.plans import preparation


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p5_found", "p6_found"])
def test_found(spark, data, name):
    table = lambda t: pq.read_table(f"{data}/{t}.parquet").to_pylist()
    want = {
        "p2_found": lambda: brute.p2(table("segment_files")), "p3_found": lambda: brute.p3(table("silhouette_files")), "p5_found": lambda: brute.p5(table("silhouette_files")),
        "p6_found": lambda: brute.p6(table("cell_measurements"), table("layers"), table("silhouette_files")),
    }[name]()
    got = [tuple(r) for r in preparation.QUERIES[name](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want
