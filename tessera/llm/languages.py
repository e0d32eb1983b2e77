"""Languages of documents and of foreign stretches in them, by cross-parsing against labelled text."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents drawn per language, at random by a hash of doc_id: with TRAINING_CHARS the bound of the sample that a model is fitted on.
TRAINING_DOCUMENTS = 200
#: Documents longer than this are not drawn.
TRAINING_LENGTH = 8_000
#: Characters of distinct lines per language that an automaton is built from.
TRAINING_CHARS = 32_000
#: Lines whose parses a task remembers before it starts anew.
REMEMBERED = 200_000
#: Longer lines are parsed in pieces, cut at a blank where there is one.
LONGEST = 2_000
#: Characters that are parsed together.
TOGETHER = 1 << 20
#: Entries of a dense table of transitions; a larger automaton keeps sorted transitions instead, with the same result.
DENSE = 1 << 24

_TAG = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
_GAP = re.compile(r"[^\w\n]+|_+")
_NUMBER = re.compile(r"(?<!\w)\d+(?!\w)")
_HIGH = "\x80-\xffŒœŠšŸŽžƒˆ˜–—‘-‚“-„†-•…‰‹›€™"
_WESTERN = re.compile(f"[{_HIGH}]{{2,}}")
_CYRILLIC = re.compile("(?:[РС][Ѐ-џҐґ -»–-›€№™]){3,}")
_BYTES = {ord(bytes([b]).decode("cp1252")): b for b in range(128, 256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {b: b for b in range(128, 256)}


def _read_as_western(run: re.Match) -> str:
    try:
        return bytes(_BYTES[ord(c)] for c in run[0]).decode("utf-8")
    except (KeyError, ValueError):
        return run[0]


def _read_as_cyrillic(run: re.Match) -> str:
    try:
        return run[0].encode("cp1251").decode("utf-8")
    except ValueError:
        return run[0]


def normalised(text: str) -> str:
    """Lower-case words of each line between single blanks, with a blank at both ends; line breaks stay.

    Markup in <> or {} is dropped, and so are numbers; 0 and 1 in a word are read as o and i, vv as w.
    Runs of characters that are UTF-8 read in a western or Cyrillic code page are read again, twice over
    if need be; what cannot be repaired stays.
    """
    text = _TAG.sub(" ", text)
    if not text.isascii():
        for _ in range(2):
            text = _WESTERN.sub(_read_as_western, text)
        text = _CYRILLIC.sub(_read_as_cyrillic, text)
    text = _NUMBER.sub(" ", text.lower()).replace("0", "o").replace("1", "i").replace("vv", "w")
    return _GAP.sub(" ", "\n".join(f" {line} " for line in text.split("\n")))


def cues(text: str) -> tuple[list[int], list[list[str]]]:
    """Printed number and raw text lines of each cue; a cue without a number has its position, from 1.

    A cue starts at a line of times with an arrow between, its number stands in the line before. Blank lines inside a cue
    and line endings of either kind do not matter.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    arrows = [at for at, line in enumerate(lines) if "->" in line and ":" in line]
    numbers, bodies = [], []
    for position, (at, following) in enumerate(pairwise([*arrows, len(lines) + 1]), 1):
        number = lines[at - 1].strip("﻿ \t") if at else ""
        numbers.append(int(number) if number.isdecimal() and len(number) < 10 else position)
        body = lines[at + 1 : following]
        if body and following <= len(lines) and lines[following - 1].strip().isdecimal():
            body.pop()
        bodies.append([line for line in body if line and not line.isspace()])
    return numbers, bodies


class Automaton:
    """Suffix automaton of a set of lines: state and symbol to state, 0 for none; 1 is the start.

    Symbols are all characters of the lines, numbered from 1; 0 is any other. Transitions are a dense table, or
    sorted keys where that would have more than ``dense`` entries.
    """

    def __init__(self, lines: list[str], dense: int = DENSE) -> None:
        self.symbols = np.array(sorted(map(ord, set("".join(lines)))), dtype=np.uint32)
        numbers = {chr(c): at for at, c in enumerate(self.symbols.tolist(), 1)}
        edges: list[dict[str, int]] = [{}, {}]
        link, longest = [0, 0], [0, 0]
        for line in lines:
            last = 1
            for c in line:
                if (there := edges[last].get(c)) and longest[there] == longest[last] + 1:
                    last = there
                    continue
                last = self._extend(edges, link, longest, last, c)
        self.width = len(numbers) + 1
        keys = np.array([state * self.width + numbers[c] for state, out in enumerate(edges) for c in out], dtype=np.int64)
        to = np.array([x for out in edges for x in out.values()], dtype=np.int32)
        if len(edges) * self.width <= dense:
            self.keys, self.to = None, np.zeros(len(edges) * self.width, dtype=np.int32)
            self.to[keys] = to
        else:
            order = np.argsort(keys)
            self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(to[order], np.int32(0))
        self.size = max(2, sum(map(len, lines)))

    @staticmethod
    def _extend(edges: list, link: list, longest: list, last: int, c: str) -> int:
        def add(out: dict, length: int, to: int) -> int:
            edges.append(out)
            longest.append(length)
            link.append(to)
            return len(edges) - 1

        def split(p: int, q: int) -> int:
            twin = add(dict(edges[q]), longest[p] + 1, link[q])
            while p and edges[p].get(c) == q:
                edges[p][c] = twin
                p = link[p]
            link[q] = twin
            return twin

        if q := edges[last].get(c):
            return split(last, q)
        new, p = add({}, longest[last] + 1, 1), last
        while p and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p:
            q = edges[p][c]
            link[new] = q if longest[q] == longest[p] + 1 else split(p, q)
        return new

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        """The symbols of characters given by code point."""
        if not len(self.symbols):
            return np.zeros(codes.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.symbols, codes), len(self.symbols) - 1)
        return np.where(self.symbols[at] == codes, at + 1, 0).astype(np.int64)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        if self.keys is None:
            return self.to[keys]
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.to[at], 0)

    def phrases(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each line's cross-parse: each the longest match with the automaton, or a symbol that it lacks.

        ``symbols`` has a line per column, shortest first, a character per row. All lines advance together.
        """
        state, count = np.ones(symbols.shape[1], dtype=np.int64), np.zeros(symbols.shape[1], dtype=np.int32)
        begins = np.searchsorted(lengths, np.arange(symbols.shape[0]), side="right")
        for row, begin in zip(symbols, begins, strict=True):
            symbol = row[begin:]
            to = self._step(state[begin:] * self.width + symbol)
            failed = np.flatnonzero(to == 0)
            if len(failed):
                inside = state[begin:][failed] != 1
                again = self._step(self.width + symbol[failed])
                count[begin + failed] += inside
                count[begin + failed] += again == 0
                to[failed] = np.where(again == 0, 1, again)
            state[begin:] = to
        return count + (state != 1)


@dataclass(frozen=True)
class Model:
    """Lines of training text per language: what automata are built from, in each process once."""

    lines: tuple[tuple[str, tuple[str, ...]], ...]


_BUILT: dict[Model, tuple[list[str], list[Automaton]]] = {}


def automata(model: Model) -> tuple[list[str], list[Automaton]]:
    if model not in _BUILT:
        _BUILT.clear()
        _BUILT[model] = ([code for code, _ in model.lines], [Automaton(list(lines)) for _, lines in model.lines])
    return _BUILT[model]


def _pieces(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, start and size of the pieces to parse: whole lines up to :data:`LONGEST`, longer ones cut behind a blank where there is one."""
    long = np.flatnonzero(sizes > LONGEST)
    if not len(long):
        return np.arange(len(starts)), starts, sizes
    lines, begins, lengths = [np.flatnonzero(sizes <= LONGEST)], [starts[sizes <= LONGEST]], [sizes[sizes <= LONGEST]]
    for line in long.tolist():
        at, end, cuts = int(starts[line]), int(starts[line] + sizes[line]), []
        while at < end:
            blanks = np.flatnonzero(codes[at : min(at + LONGEST, end)] == 32)
            upto = end if end - at <= LONGEST else at + (int(blanks[-1]) if len(blanks) and blanks[-1] else LONGEST)
            cuts.append((at, upto - at))
            at = upto
        lines.append(np.full(len(cuts), line))
        begins.append(np.array([c[0] for c in cuts]))
        lengths.append(np.array([c[1] for c in cuts]))
    return np.concatenate(lines), np.concatenate(begins), np.concatenate(lengths)


def parse_lines(lines: list[str], built: list[Automaton], together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray]:
    """For each raw line: cross-parse cost per language in bits (phrases times the bits of a place in the training text), and letters.

    Lines of about equal length are parsed together, ``together`` characters at a time. A line over
    :data:`LONGEST` characters is parsed in pieces, which adds at most one phrase a piece in every language.
    """
    codes = np.frombuffer(normalised("\n".join(lines)).encode("utf-32-le", "replace"), dtype=np.uint32)
    ends = np.r_[np.flatnonzero(codes == 10), len(codes)]
    starts = np.r_[0, ends[:-1] + 1]
    sizes = ends - starts
    letters = np.add.reduceat(np.r_[(codes != 32) & (codes != 10), False].astype(np.int32), starts)
    letters[sizes == 0] = 0
    costs = np.zeros((len(lines), len(built)))
    line, begin, length = _pieces(codes, starts, sizes)
    order = np.argsort(length, kind="stable")
    order = order[letters[line[order]] > 0]
    alphabet = np.unique(np.concatenate([automaton.symbols for automaton in built])) if built else np.zeros(0, dtype=np.uint32)
    if not len(alphabet):
        return costs, letters
    nearest = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    shared = np.where(alphabet[nearest] == codes, nearest + 1, 0).astype(np.uint16 if len(alphabet) < 65_535 else np.uint32)
    numbered = [np.r_[0, automaton.numbered(alphabet)] for automaton in built]
    at = 0
    while at < len(order):
        longest = np.maximum(length[order[at:]], 1)
        some = order[at : at + max(1, int(np.searchsorted(longest * np.arange(1, len(longest) + 1), together, side="right")))]
        lengths = length[some]
        square = shared[np.minimum(begin[some] + np.arange(lengths[-1])[:, None], len(codes) - 1)]
        for k, automaton in enumerate(built):
            found = automaton.phrases(numbered[k][square], lengths) * math.log2(automaton.size)
            costs[:, k] += np.bincount(line[some], found, len(lines))
        at += len(some)
    return costs, letters


def training_sample(documents: DataFrame, codes: dict[str, str], per_language: int = TRAINING_DOCUMENTS) -> list[tuple[str, str]]:
    """(lang_code, text) of at most ``per_language`` documents of each labelled language, chosen by a hash of doc_id.

    The choice runs over doc_ids alone and only its first rows per language leave a task; then the
    chosen texts are read. At most per_language x languages x TRAINING_LENGTH characters reach the driver.
    """
    spark = documents.sparkSession
    alias = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]) if codes else None
    if alias is None:
        return []
    labelled = documents.filter(F.col("n_chars").between(1, TRAINING_LENGTH)).select("doc_id", F.try_element_at(alias, F.col("lang")).alias("code")).filter("code is not null")
    first = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= per_language).select("doc_id", "code")
    listed = chosen.toArrow()
    if not listed.num_rows:
        return []
    rows = spark.createDataFrame(listed)
    texts = documents.filter(F.col("n_chars").between(1, TRAINING_LENGTH)).select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return [(r["code"], r["text"]) for r in texts.select("code", "text", "doc_id").orderBy("code", F.xxhash64("doc_id"), "doc_id").collect() if r["text"]]


def fit(sample: list[tuple[str, str]], chars: int = TRAINING_CHARS) -> Model:
    """Clean labelled text per language from a sample whose labels are partly wrong and whose texts are partly mixed.

    A word's share in a language is the part of that language's documents that hold it, shrunk as if three
    more documents did not. A cue is attributed to the language whose shares of its words have the
    largest product. Wrong labels are the smaller part of a language's documents, so its own words have
    their largest share there; the words of a label that is only ever wrong have a larger one elsewhere.
    A cue's lines count for the language of its document's label if that is the language of the line, of
    the cue and of most cues of the document. A language less than a fifth of whose documents remain
    gets no automaton, and the rest start anew without it. The lines in most documents come first, up to
    ``chars`` characters.
    """
    documents = defaultdict(list)
    for code, text in sample:
        parts = [normalised("\n".join(body)) for body in cues(text)[1]]
        if any(words := [set(part.split()) for part in parts]):
            documents[code].append((words, parts))
    while documents:
        codes = sorted(documents)
        seen = {code: Counter(w for words, _ in documents[code] for w in set().union(*words)) for code in codes}
        weights = {w: np.log([seen[c][w] / (len(documents[c]) + 3) + 0.003 for c in codes]) for w in set().union(*seen.values())}
        attributed = lambda words: int(sum(weights[w] for w in words).argmax()) if words else -1  # noqa: B023, E731
        lines, only_wrong = [], []
        for own, code in enumerate(codes):
            texts: Counter[str] = Counter()
            kept = 0
            for words, parts in documents[code]:
                of = [attributed(w) for w in words]
                if 2 * of.count(own) > sum(o >= 0 for o in of):
                    kept += 1
                    texts.update({line for o, part in zip(of, parts, strict=True) if o == own for line in part.split("\n") if attributed(set(line.split())) == own})
            often = sorted(texts, key=lambda line: (-texts[line], zlib.crc32(line.encode()), line))  # noqa: B023
            if 5 * kept < len(documents[code]) or not often:
                only_wrong.append(code)
            else:
                lines.append((code, tuple(often[: int(np.searchsorted(np.cumsum([len(line) for line in often]), chars)) + 1])))
        if not only_wrong:
            return Model(tuple(lines))
        for code in only_wrong:
            del documents[code]
    return Model(())


FOUND = "doc_id bigint, label string, is_run boolean, cue_no int, last_cue int, n_cues int, lang string, confidence double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("is_run", pa.bool_()), ("cue_no", pa.int32()), ("last_cue", pa.int32()), ("n_cues", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])


def _decide(costs: np.ndarray, letters: np.ndarray) -> tuple[list[int], list[float]]:
    """Cheapest language and its margin over the next (0 to 1) of each cue; -1 without letters, -2 if two are cheapest."""
    if costs.shape[1] == 1:
        return np.where(letters > 0, 0, -1).tolist(), np.ones(len(costs)).tolist()
    two = np.partition(costs, 1, axis=1)[:, :2]
    best = np.where(letters == 0, -1, np.where(two[:, 1] - two[:, 0] < 1e-9, -2, costs.argmin(axis=1)))
    return best.tolist(), (1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)).tolist()


def _document(best: list[int], margin: list[float], cost: np.ndarray, numbers: list[int], least_run: int) -> list[tuple]:
    """The main language and the runs of other languages: (whether a run, first number, last number, cues, language, confidence)."""
    votes = Counter(b for b in best if b >= 0)
    if not votes:
        return []
    guess = min(votes, key=lambda b: (-votes[b], b))
    now, filled = guess, []
    for at, b in enumerate(best):
        if b == -2:
            low = cost[at].min() + 1e-9
            b = now if cost[at, now] <= low else guess if cost[at, guess] <= low else int(cost[at].argmin())
        if b >= 0:
            now = b
        filled.append(now)
    votes = Counter(filled)
    main = min(votes, key=lambda b: (-votes[b], b))
    mean = lambda ats: sum(margin[a] for a in ats) / len(ats)
    out = [(False, 0, numbers[-1], votes[main], main, votes[main] / len(filled) * mean([a for a, b in enumerate(filled) if b == main]))]
    start = 0
    for at in range(1, len(filled) + 1):
        if at == len(filled) or filled[at] != filled[start]:
            if filled[start] != main and at - start >= least_run:
                out.append((True, numbers[start], numbers[at - 1], at - start, filled[start], mean(range(start, at))))
            start = at
    return out


def identify(documents: DataFrame, model: Model, least_run: int = 3, together: int = 500) -> DataFrame:
    """Language of each document and of each run of at least ``least_run`` cues in another language.

    Returns doc_id, label (as delivered), is_run, cue_no (0 for the document, else the printed number of the
    run's first cue), last_cue, n_cues, lang, confidence (0 to 1: mean margin of the cheapest language
    over the next, for a document times its share of cues). A cue's cost in a language is the number of
    phrases into which the language's suffix automaton cuts its lines, in bits. Equal costs go to the
    language of the cue before. A cue without words takes the language of the cue before.

    Whole texts are parsed where they are read; nothing is shuffled. Equal lines are parsed once while a
    task remembers them. Documents that are null, empty or without words, and any if there is no
    labelled text, have no row; a text without cues neither.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, built = automata(shared.value)
        known: dict[str, int] = {}
        costs, letters = np.zeros((0, len(built))), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                if len(known) > REMEMBERED:
                    known, costs, letters = {}, costs[:0], letters[:0]
                ids, labels, texts = (c.to_pylist() for c in batch.slice(at, together).columns)
                parsed, flat, per_cue, fresh = [], [], [], []
                for text in texts:
                    numbers, bodies = cues(text) if text else ([], [])
                    parsed.append(numbers)
                    for body in bodies:
                        per_cue.append(len(body))
                        for line in body:
                            k = known.get(line)
                            if k is None:
                                k = known[line] = len(known)
                                fresh.append(line)
                            flat.append(k)
                if fresh:
                    new_costs, new_letters = parse_lines(fresh, built)
                    costs, letters = np.concatenate([costs, new_costs]), np.concatenate([letters, new_letters])
                edges = np.r_[0, np.cumsum(per_cue, dtype=np.int64)].astype(np.int64)
                sums = np.concatenate([np.zeros((1, len(built))), np.cumsum(costs[flat], axis=0)])
                totals = np.r_[0, np.cumsum(letters[flat])]
                cost, words = sums[edges[1:]] - sums[edges[:-1]], totals[edges[1:]] - totals[edges[:-1]]
                best, margin = _decide(cost, words) if len(cost) and built else ([], [])
                rows, begin = [], 0
                for doc, label, numbers in zip(ids, labels, parsed, strict=True):
                    end = begin + len(numbers)
                    for run, first, last, n, lang, sure in _document(best[begin:end], margin[begin:end], cost[begin:end], numbers, least_run) if numbers and best else ():
                        rows.append((doc, label, run, first, last, n, codes[lang], float(sure)))
                    begin = end
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return documents.select("doc_id", "lang", "text").mapInArrow(read, FOUND)


def wrong_or_mixed(found: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Rows of :func:`identify` that matter: runs, and documents whose label is no alias or one of another language."""
    alias = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]) if codes else None
    code = F.lit(None).cast("string") if alias is None else F.try_element_at(alias, F.col("label"))
    return found.filter(F.col("is_run") | ~code.eqNullSafe(F.col("lang")))
