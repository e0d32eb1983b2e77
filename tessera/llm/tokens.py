"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank file of a byte-level BPE; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before merges (fixed value of these rank files).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts whose counts a task remembers before it starts anew.
REMEMBERED = 300_000

_BREAK = re.compile(r"(\s*\n)")


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer of a rank file, once per process."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def counter(vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    """A function that counts a text's tokens, remembering the lines it has met.

    The pattern never lets a token cross from a line into the break after it, nor, where the next line
    starts without a blank, out of the break. So counts add up over lines and breaks; within a line of
    times they add up over its two ends, and at the comma before thousandths. Texts with a line that
    starts with a blank are encoded whole. Results equal those of encoding the text at once.
    """
    encode = encoding(vocabulary).encode_ordinary
    known: dict[str, int] = {}
    breaks: dict[str, int] = {}

    def piece(text: str) -> int:
        n = known.get(text)
        if n is None:
            if len(known) > REMEMBERED:
                known.clear()
            n = known[text] = len(encode(text))
        return n

    def time(text: str, before: str) -> int:
        head, comma, tail = text.rpartition(",")
        if head and tail.isdigit() and head[-1].isdigit():
            return piece(before + head) + piece(comma + tail)
        return len(encode(before + text))

    def count(text: str) -> int:
        parts = _BREAK.split(text)
        lines = parts[0::2]
        if any(line[:1].isspace() for line in lines[1:]):
            return len(encode(text))
        total = 0
        for line in lines:
            start, arrow, end = line.partition(" --> ")
            if arrow and start[-1:].isdigit() and end[:1].isdigit():
                total += time(start, "") + time(end, arrow)
            elif line:
                total += piece(line)
        last = len(parts) - 2 if len(parts) > 1 and not lines[-1] else -1
        for at in range(1, len(parts), 2):
            gap = parts[at]
            if at == last:
                total += len(encode(gap))
                continue
            n = breaks.get(gap)
            if n is None:
                if len(breaks) > REMEMBERED:
                    breaks.clear()
                n = breaks[gap] = len(encode(gap + "a")) - len(encode("a"))
            total += n
        return total

    return count


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """BIGINT number of tokens of whole texts; 0 for an empty text, null for null."""

    @F.pandas_udf("bigint")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocabulary)
        for batch in batches:
            yield pd.Series([None if t is None else count(t) for t in batch], dtype="Int64")

    return counts(text)
