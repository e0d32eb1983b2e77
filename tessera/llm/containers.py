"""Fixed-capacity containers filled with texts, certified by lower bounds."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, discard

#: Texts that one task packs together.
GROUP = 20_000


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece_no (from 0), tokens: a text that exceeds ``capacity`` becomes full pieces and a rest, others stay whole.

    Texts of null size have no piece; a text of size 0 has one of size 0. Splitting keeps order: piece k
    holds tokens from k * capacity on.
    """
    size = F.col("tokens").cast("bigint")
    last = F.greatest(F.ceil(size / capacity) - 1, F.lit(0)).cast("int")
    cutted = sizes.filter("tokens is not null").select("doc_id", size.alias("tokens"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    return cutted.select("doc_id", "piece_no", F.least(F.lit(capacity), F.col("tokens") - F.col("piece_no").cast("bigint") * capacity).cast("int").alias("tokens"))


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of containers that the dual-feasible functions below give.

    A function u on [0, 1] is dual feasible if shares that sum to at most 1 keep doing so under u; then
    the sum of u(size / capacity), rounded up, bounds the number of containers. Used are the identity;
    for each threshold e up to 1/2 the function that raises sizes over 1 - e to 1 and drops those under
    e; and for k up to 20 the rounding of (k + 1) x down to k-ths, where (k + 1) x is not whole.
    """
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """:func:`lower_bound` from the number of items of each size, 0 to ``capacity``."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(counts @ x) // capacity)
    below, above = np.cumsum(counts * x), np.cumsum(counts[::-1])[::-1]
    e = np.arange(1, capacity // 2 + 1)
    kept = below[capacity - e] - below[e - 1]
    large = np.r_[above, 0][capacity - e + 1]
    if len(e):
        best = max(best, int(np.max(large + -(-kept // capacity))))
    for k in range(1, 21):
        scaled = (k + 1) * x
        u = np.where(scaled % capacity == 0, k * x, (scaled // capacity) * capacity)
        best = max(best, -(-int(counts @ u) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: largest first, into the fullest container that still holds it.

    The free spaces present are the bits of one integer, so the least one that is large enough is found
    by a shift.
    """
    out = np.empty(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, used = 0, 0
    for at in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[at])
        fitting = present >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            which = free[space].pop()
            if not free[space]:
                present ^= 1 << space
        else:
            space, which, used = capacity, used, used + 1
        out[at] = which
        free[space - size].append(which)
        present |= 1 << (space - size)
    return out


def _packed(items: DataFrame, capacity: int, groups: int, turn: int) -> DataFrame:
    """Pack hash groups of about equal size, each in a task, with the group's certified bound."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece_no"], ignore_index=True)
        sizes = group["tokens"].to_numpy()
        where = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(where, weights=sizes).astype(np.int64)
        return group.assign(container=where, fill=fill[where], used=int(where.max()) + 1, bound=lower_bound(sizes, capacity))

    hashed = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(turn)), F.lit(groups)).cast("int")).withColumn("turn", F.lit(turn))
    return hashed.groupBy("part").applyInPandas(pack, "doc_id bigint, piece_no int, tokens int, part int, turn int, container bigint, fill bigint, used bigint, bound bigint")


@dataclass(frozen=True)
class Packing:
    """``rows``: doc_id, piece_no, tokens, container_id, fill; ``least``: containers that any packing needs, by a dual-feasible function; ``turns`` taken."""

    rows: DataFrame
    capacity: int
    least: int
    turns: int


def least_containers(pieces: DataFrame, capacity: int) -> int:
    """The certified bound over all pieces: :func:`lower_bound` of their counts by size, of which there are at most ``capacity`` + 1."""
    counts = pieces.groupBy("tokens").agg(F.count("*").alias("n")).collect()
    by_size = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts:
        by_size[r["tokens"]] = r["n"]
    return bound_of_counts(by_size, capacity)


def pack(sizes: DataFrame, capacity: int, group: int = GROUP, slack: float = 0.02, stop: int = 3) -> Packing:
    """Fill containers of ``capacity`` with the texts of ``sizes`` (doc_id, tokens).

    Hash groups of about ``group`` pieces are packed best-fit decreasing, and dual-feasible functions certify how
    few containers each group could do with. Groups above their bound, and the containers of all groups that
    are left with more than ``slack`` of the capacity free, give up the pieces of their open containers;
    these are dealt into new groups, which mixes pieces of different groups, and packed again. A turn
    counts only if it saves containers. It ends when what is open, or all, is at its bound, or when ``stop`` dealings in a row
    saved nothing; the bound of the whole is part of the result, so a gap is seen.

    No text is split unless it alone exceeds ``capacity``, and every piece is in exactly one container: the
    packed pieces and tokens are counted against those that came in, and a difference is an error.
    Repeated doc_ids are packed as often as they occur. No texts, no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    waiting = cut(pieces(sizes, capacity), "pieces")
    least = least_containers(waiting, capacity)
    closed: list[DataFrame] = []
    count, tokens = waiting.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    current = cut(_packed(waiting, capacity, max(1, math.ceil(count / group)), 0), "packed")
    used = lambda df: df.select("turn", "part", "container").distinct().count()
    open_ = (F.col("fill") < (1 - slack) * capacity) | ((F.col("used") > F.col("bound")) & (F.col("fill") < capacity - 1))
    released, turn, idle, kept = None, 0, 0, 0
    while idle < stop:
        if released is None:
            released = cut(current.filter(open_), "released")
            before = used(released)
            freed = released.count()
            open_least = least_containers(released, capacity)
            whole = kept + used(current)
        if before <= max(1, open_least) or whole <= least:
            break
        turn += 1
        again = cut(_packed(released.select("doc_id", "piece_no", "tokens"), capacity, max(1, math.ceil(freed / group)), turn), "packed")
        if used(again) >= before:
            discard(again)
            idle += 1
            continue
        idle = 0
        shut = current.filter(~open_)
        closed.append(shut)
        kept += used(shut)
        current = again
        discard(released)
        released = None
    out = current
    for part in closed:
        out = out.unionByName(part)
    placed, held = out.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if (placed, held) != (count, tokens):
        raise RuntimeError(f"{placed} pieces of {held} tokens are packed, {count} of {tokens} came in")
    return Packing(out.select("doc_id", "piece_no", "tokens", F.concat_ws("-", "turn", "part", "container").alias("container_id"), "fill"), capacity, least, turn)


def split_texts(packing: Packing) -> DataFrame:
    """doc_id of the texts that fill at least one container of the packing whole and go on in another: those that had to be split.

    A text is split only where it exceeds the capacity, so its first piece is a full container of its own.
    """
    parts = packing.rows.groupBy("doc_id").agg(F.count_distinct("container_id").alias("_in"), F.max("piece_no").alias("_last"), F.max("fill").alias("_fill"))
    return parts.filter((F.col("_last") > 0) & (F.col("_in") > F.col("_last")) & (F.col("_fill") == packing.capacity)).select("doc_id")


def report(packing: Packing) -> DataFrame:
    """One row: pieces, split texts, containers, the certified least number that any packing needs, share of space used."""
    total = packing.rows.agg(
        F.count("*").alias("pieces"), F.sum(F.when(F.col("piece_no") == 1, 1).otherwise(0)).alias("split_texts"),
        F.count_distinct("container_id").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )
    return total.select(
        F.lit(packing.capacity).alias("capacity_tokens"), "pieces", F.coalesce("split_texts", F.lit(0)).alias("split_texts"), "containers", F.lit(packing.least).cast("bigint").alias("least_containers"),
        (F.col("tokens") / F.nullif(F.col("containers") * packing.capacity, F.lit(0))).alias("used_share"),
    )


def filled(documents: DataFrame, packed: DataFrame, capacity: int, vocabulary: str, separator: str = "\n") -> DataFrame:
    """container_id and text: the texts of each container joined in order of doc_id; pieces of long texts are cut at token borders.

    A piece that starts or ends inside a character keeps the whole bytes of its tokens, so the pieces of a
    text, taken as bytes, add up to it.
    """
    from tessera.llm.tokens import encoding

    @F.pandas_udf("string")
    def part(text: pd.Series, piece: pd.Series, split: pd.Series) -> pd.Series:
        enc = encoding(vocabulary)
        take = lambda t, k: enc.decode_bytes(enc.encode_ordinary(t)[k * capacity : (k + 1) * capacity]).decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()
        return pd.Series([take(t, k) if s else t for t, k, s in zip(text, piece, split, strict=True)])

    split = packed.filter("piece_no = 1").select("doc_id", F.lit(True).alias("_split"))
    joined = packed.join(split, "doc_id", "left").join(documents.select("doc_id", "text"), "doc_id")
    cutted = joined.select("container_id", "doc_id", "piece_no", part("text", "piece_no", F.coalesce("_split", F.lit(False))).alias("text"))
    return cutted.groupBy("container_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "piece_no", "text"))), lambda p: p["text"]), separator).alias("text"))
