from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import containers, tokens

PIECES = st.sampled_from(["\n", "\r\n", " ", "a", "Zé", " --> ", "00:01:02,345", "12", ",", "\t", "'s", "-", "日本", " ", "x\n", "ь", " ", "!!", "  "])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_counts_equal_the_tokenizer(text):
    assert tokens.counter()(text) == len(tokens.encoding().encode_ordinary(text))


def test_token_column(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "x " * 60_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.n for r in df.select("doc_id", tokens.token_count(F.col("text")).alias("n")).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] is None and got[4] == len(tokens.encoding().encode_ordinary("x " * 60_000))


def sizes(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, tokens bigint, container string, fill int")


def packed(spark, rows, capacity, **k):
    done = containers.pack(sizes(spark, rows), capacity, **k)
    out = done.rows
    assert {r.doc_id for r in containers.split_texts(done).collect()} == {i for i, t in rows if (t or 0) > capacity}
    bins, pieces = defaultdict(int), defaultdict(list)
    for r in out.collect():
        bins[r.container_id] += r.tokens
        pieces[r.doc_id].append((r.piece_no, r.tokens))
        assert r.fill <= capacity
    assert containers.report(done).first().least_containers == done.least <= len(bins)
    assert all(v <= capacity for v in bins.values())
    return bins, pieces


def test_every_text_whole_or_split_in_order(spark):
    rows = [(i, int(t)) for i, t in enumerate(np.random.default_rng(0).integers(0, 90, 800))] + [(900, 250), (901, 100), (902, 101), (903, None), (904, 0)]
    bins, pieces = packed(spark, rows, 100, group=200)
    assert sum(bins.values()) == sum(t or 0 for _, t in rows)
    assert {i for i, p in pieces.items() if len(p) > 1} == {900, 902} and 903 not in pieces
    assert sorted(pieces[900]) == [(0, 100), (1, 100), (2, 50)] and sorted(pieces[902]) == [(0, 100), (1, 1)]
    least = containers.lower_bound(np.array([t for p in pieces.values() for _, t in p]), 100)
    assert len(bins) <= 1.02 * least + 2


def test_repeated_ties_and_empty(spark):
    bins, pieces = packed(spark, [(1, 50)] * 5 + [(k, 50) for k in range(2, 7)], 100)
    assert len(bins) == 5 and len(pieces[1]) == 5
    assert packed(spark, [], 100) == ({}, {})
    assert containers.report(containers.pack(sizes(spark, []), 100)).first().containers == 0
    with pytest.raises(ValueError):
        containers.pack(sizes(spark, []), 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_bounds_hold_the_optimum(items):
    capacity = 30
    best = len(items)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(items):
            best = len(free)
            return
        for i in range(len(free)):
            if free[i] >= items[k]:
                place(k + 1, [*free[:i], free[i] - items[k], *free[i + 1 :]])
        place(k + 1, [*free, capacity - items[k]])

    place(0, [])
    where = containers.best_fit_decreasing(np.array(items), capacity)
    fill = np.bincount(where, weights=items)
    assert fill.max() <= capacity
    assert containers.lower_bound(np.array(items), capacity) <= best <= where.max() + 1


def test_dealing_goes_on_while_it_saves(spark):
    """Pairs that fill a container only together, in many small groups: dealt again until the bound is reached or nothing is saved."""
    rows = [(i, int(t)) for i, t in enumerate(np.random.default_rng(1).permutation(np.r_[np.arange(51, 91), 100 - np.arange(51, 91)].repeat(8)))]
    done = containers.pack(sizes(spark, rows), 100, group=20)
    assert done.least == 320 and done.turns > 4
    assert containers.report(done).first().containers <= 1.05 * done.least


def test_dual_feasible_functions_beat_the_sum():
    assert containers.lower_bound(np.array([51] * 10), 100) == 10
    assert containers.lower_bound(np.array([34] * 9), 100) == 5


def test_texts_of_containers(spark):
    texts = {1: "one two three four five six", 2: "seven", 3: "eight nine"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    counted = df.select("doc_id", tokens.token_count(F.col("text")).alias("tokens"))
    out = containers.pack(counted, 4)
    filled = containers.filled(df, out.rows, 4, tokens.VOCABULARY, separator="|").collect()
    words = Counter(w for r in filled for w in r.text.replace("|", " ").split())
    assert words == Counter(" ".join(texts.values()).split())
