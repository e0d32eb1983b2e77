import numpy as np
import pytest

from tessera.llm import languages

EN = "the old boat is ready|we can talk about that tomorrow|nobody wanted the broken lantern|my father built this house|who took the letter from the mill|it has been quiet since the storm".split("|")
DE = "das alte boot ist fertig|darüber können wir morgen reden|niemand wollte die kaputte laterne|mein vater hat dieses haus gebaut|wer hat den brief aus der mühle genommen|seit dem sturm ist es ruhig".split("|")
RU = "старая лодка готова|об этом мы поговорим завтра|никто не хотел разбитый фонарь|мой отец построил этот дом|кто взял письмо с мельницы|после бури здесь очень тихо".split("|")
TEXT = {"en": EN, "de": DE, "ru": RU}


def document(parts, end="\n", numbers=True, arrow=" --> "):
    out = []
    for k, line in enumerate(parts, 1):
        out += ([str(k)] if numbers else []) + [f"00:00:{k:02d},000{arrow}00:00:{k:02d},900", line, ""]
    return end.join(out)


def corpus(rng, n, code):
    return [document([TEXT[code][i] for i in rng.integers(0, 6, 8)]) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    sample = [(code, t) for code in TEXT for t in corpus(rng, 40, code)]
    sample += [("en", t) for t in corpus(rng, 4, "de")] + [("hu", t) for t in corpus(rng, 6, "en")] + [("hu", t) for t in corpus(rng, 3, "ru")] + [("cs", "no cues")]
    return languages.fit(sample)


def longest_phrases(text, known):
    n, at = 0, 0
    while at < len(text):
        size = 0
        while at + size < len(text) and any(text[at : at + size + 1] in k for k in known):
            size += 1
        at += max(1, size)
        n += 1
    return n


def test_automaton_parses_as_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        known = [" " + "".join(rng.choice(list("ab c"), rng.integers(1, 30))) + " " for _ in range(3)]
        lines = ["".join(rng.choice(list("abc z"), rng.integers(1, 25))) for _ in range(20)]
        lines.sort(key=len)
        codes = np.full((max(map(len, lines)), len(lines)), 32, dtype=np.uint16)
        for k, line in enumerate(lines):
            codes[: len(line), k] = [ord(c) for c in line]
        for dense in (languages.DENSE, 0):
            automaton = languages.Automaton(known, dense)
            got = automaton.phrases(automaton.numbered(codes), np.array([len(x) for x in lines]))
            assert got.tolist() == [longest_phrases(x, known) for x in lines]


def test_alphabets_of_any_size():
    """A thousand Han characters, some beyond the basic plane: all are read, and every line is parsed as by definition."""
    rng = np.random.default_rng(6)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 1000)] + [chr(c) for c in range(0x20000, 0x20030)]
    known = ["".join(rng.permutation(letters)[i : i + 40]) for i in range(0, len(letters), 40)] + ["".join(letters[i : i + 40]) for i in range(0, len(letters), 40)]
    built = [languages.Automaton([f" {x} " for x in known]), languages.Automaton([" latin text only "])]
    assert len(built[0].symbols) == len(letters) + 1
    lines = ["".join(letters[i : i + 17]) for i in range(0, 900, 50)] + ["".join(rng.choice(letters, 12))]
    costs, counted = languages.parse_lines(lines, built)
    bits = np.log2([a.size for a in built])
    want = [[longest_phrases(f" {x} ", [f" {y} " for y in known]) * bits[0], longest_phrases(f" {x} ", [" latin text only "]) * bits[1]] for x in lines]
    assert np.allclose(costs, want) and counted.tolist() == [len(x) for x in lines]
    assert (costs[:-1, 0] < costs[:-1, 1]).all()


def test_very_long_lines_are_parsed_in_pieces(model):
    codes, built = languages.automata(model)
    long, solid = " ".join(DE) * 2000, "boot" * 5000
    costs, letters = languages.parse_lines([long, DE[0], solid], built, together=1000)
    assert codes[int(costs[0].argmin())] == "de" and len(long) > 300_000 and letters[2] == 20_000
    alone = languages.parse_lines([DE[0]], built)[0][0]
    assert np.allclose(costs[1], alone)


def test_wrong_labels_do_not_train(model):
    assert [code for code, _ in model.lines] == ["de", "en", "ru"]
    lines = dict(model.lines)
    assert not any("boot" in x for x in lines["en"]) and any("boat" in x for x in lines["en"])


def test_documents_and_stretches(spark, model):
    broken = DE[1].encode().decode("cp1252")
    docs = [
        (1, document(EN), "en"), (2, document(DE), "en"), (3, document(EN[:3] + DE[:3] + EN), "English"), (4, document(EN + ["♪", *RU[:2], EN[0]], "\r\n"), "xx"),
        (5, document([*EN, *RU[:3], "...", "", EN[0]]), None), (6, document([broken, *DE], arrow="->"), "de"), (7, document([x.upper() for x in DE], numbers=False), "de"),
        (8, None, "en"), (9, "", "en"), (10, "no cues at all", "en"), (11, document(["♪", "123"]), "en"), (12, document(EN * 3000), "en"), (12, document(EN * 3000), "en"),
        (13, document([*EN, *EN, *["<i>" + x for x in DE[:3]], *RU[:3], *EN]), "en"),
    ]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id bigint, text string, lang string, confidence double").repartition(4)
    found = languages.identify(df, model)
    codes = {"en": "en", "English": "en", "de": "de"}
    got = {(r.doc_id, r.cue_no, r.lang) for r in languages.wrong_or_mixed(found, codes).collect()}
    assert got == {(2, 0, "de"), (3, 4, "de"), (4, 0, "en"), (5, 0, "en"), (5, 7, "ru"), (13, 13, "de"), (13, 16, "ru")}
    rows = found.collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, 12, 13} and all(0 <= r.confidence <= 1 for r in rows)
    assert next(r.n_cues for r in rows if r.doc_id == 5 and r.is_run) == 5
    assert languages.identify(df.limit(0), model).count() == 0


def test_without_labels_nothing_is_found(spark):
    df = spark.createDataFrame([(1, document(EN), "en", 5)], "doc_id bigint, text string, lang string, n_chars bigint")
    assert languages.training_sample(df, {}) == [] and languages.training_sample(df, {"de": "de"}) == []
    assert languages.identify(df, languages.fit([])).count() == 0


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, "x", "en" if i % 3 else "de", 1 if i != 5 else 10**6) for i in range(300)], "doc_id bigint, text string, lang string, n_chars bigint")
    sample = languages.training_sample(df, {"en": "en", "de": "de"}, 20)
    assert sorted(c for c, _ in sample) == ["de"] * 20 + ["en"] * 20


def test_cues():
    numbers, bodies = languages.cues("﻿3\r\n00:00:01,000 --> 00:00:02,000\r\na\r\n\r\nb\r\n\r\n5\r\n0O:00:03.000->00:00:04.000\r\n7 days\r\n\r\n\r\n00:00:05,000 --> 00:00:06,000\r\n")
    assert numbers == [3, 5, 3] and bodies == [["a", "b"], ["7 days"], []]


def test_held_out_accuracy(spark):
    """On the delivered documents: labels that say a known language agree with what is found for nearly all of them."""
    from tessera.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    codes = {r["alias"]: r["lang_code"] for r in spark.read.parquet(f"{d}/language_codes.parquet").collect()}
    rows = [r for r in QUERIES["p9_languages"](spark, d).filter("not is_run").collect() if r.label in codes]
    assert sum(codes[r.label] == r.lang for r in rows) / len(rows) > 0.9
