import pytest
from pyspark.sql import functions as F

from tessera.llm import mixtures


def tables(spark, docs, targets):
    d = spark.createDataFrame([(i, s, t, 9, "x") for i, s, t in docs], "doc_id bigint, source string, tokens bigint, copies int, share string")
    t = spark.createDataFrame([(s, float(w) if w is not None else None, m, 1) for s, w, m in targets], "source string, weight double, max_repeats int, tokens int")
    return d, t


def test_shares_are_reached_and_caps_hold(spark):
    docs = [(i, " Big ", 100 + i % 50) for i in range(4000)] + [(10_000 + i, "small", 120) for i in range(30)] + [(20_000 + i, "MID", 80 + i % 7) for i in range(1000)] + [(30_000, None, 500), (30_001, "none", 500), (30_002, "big", None), (30_003, "big", 0)]
    done = mixtures.mix(*tables(spark, docs, [("big", 5.0, 2), ("BIG ", 1.0, 1), ("small", 3.0, 4), ("mid", 2.0, 6), ("absent", 1.0, 3), (None, 1.0, 1), ("zero", 0.0, 2), ("odd", None, 2)]))
    total = sum(t or 0 for _, _, t in docs)
    report = {r.source: r for r in done.report.collect()}
    assert set(report) == {"big", "small", "mid", "absent"}
    assert report["big"].share == pytest.approx(0.5) and report["big"].max_repeats == 2
    for s in ("big", "mid"):
        assert not report[s].below and report[s].mixed_tokens == pytest.approx(report[s].share * total, rel=0.03)
    assert report["small"].below and report["small"].mixed_tokens == 30 * 120 * 4 and report["absent"].below and report["absent"].mixed_tokens == 0
    chosen = done.chosen.collect()
    assert len(chosen) == len({r.doc_id for r in chosen}) and max(r.copies for r in chosen if r.source == "big") <= 2 and all(r.copies == 4 for r in chosen if r.source == "small")
    again = mixtures.mix(*tables(spark, docs, [("big", 5.0, 2), ("BIG ", 1.0, 1), ("small", 3.0, 4), ("mid", 2.0, 6), ("absent", 1.0, 3)]))
    assert again.chosen.exceptAll(done.chosen).count() == 0


def test_sample_has_fixed_size_and_unequal_probabilities(spark):
    docs = [(i, "s", 400 if i % 2 else 25) for i in range(4000)]
    done = mixtures.mix(*tables(spark, docs, [("s", 1.0, 1), ("t", 4.0, 1)]))
    longs = done.chosen.filter("tokens = 400").count() / 2000
    shorts = done.chosen.filter("tokens = 25").count() / 2000
    assert longs / shorts == pytest.approx(4, rel=0.25)
    expected = sum(t for _, _, t in docs) / 5
    assert done.chosen.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] == pytest.approx(expected, rel=0.02)


def test_many_rounds_until_the_capped_documents_settle(spark):
    """Sizes that grow by powers cap one document after another: more rounds than any fixed small number."""
    docs = [(i, "s", 3**i) for i in range(30)] + [(100, "t", 3**29)]
    total = sum(t for _, _, t in docs)
    row = mixtures.mix(*tables(spark, docs, [("s", 0.49, 1), ("t", 0.51, 9)]), length_power=4.0).report.filter("source = 's'").first()
    assert row.mixed_tokens == pytest.approx(0.49 * total, rel=0.4) and not row.below


def test_ties_in_one_source_and_empty(spark):
    docs = [(7, "s", 10)] * 5 + [(i, "s", 10) for i in range(100, 195)]
    assert mixtures.mix(*tables(spark, docs, [("s", 1.0, 3), ("t", 1.0, 1)])).chosen.agg(F.sum("copies")).first()[0] == pytest.approx(50, abs=5)
    none = mixtures.mix(*tables(spark, [], [("s", 1.0, 3)]))
    assert none.chosen.count() == 0 and none.report.first().mixed_tokens == 0
    assert mixtures.mix(*tables(spark, docs, [])).report.count() == 0
