import oracle
import pytest

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, data, name):
    assert oracle.differences(spark, data, queries.QUERIES[name], queries.SQL[name]) == ([], [])


def test_split_texts_and_sources_below_their_share(spark, data):
    """p7_found and p8_found against counts of whole texts by the tokenizer."""
    import pyarrow.parquet as pq

    from tessera.llm.tokens import encoding

    table = lambda t: pq.read_table(f"{data}/{t}.parquet").to_pylist()
    encode = encoding().encode_ordinary
    size = {r["doc_id"]: (r["source"].strip().lower(), len(encode(r["text"]))) for r in table("documents")}
    capacity = next(r["capacity_tokens"] for r in table("pack_bins") if r["bin_kind"] == "long")
    assert {r.doc_id for r in queries.QUERIES["p7_found"](spark, data).collect()} == {i for i, (_, n) in size.items() if n > capacity}
    targets = table("mix_targets")
    weights = sum(r["weight"] for r in targets)
    held = lambda s: sum(n for k, n in size.values() if k == s)
    below = {s for r in targets if held(s := r["source"].strip().lower()) * r["max_repeats"] < r["weight"] / weights * sum(n for _, n in size.values())}
    assert {r.source for r in queries.QUERIES["p8_found"](spark, data).collect()} == below
