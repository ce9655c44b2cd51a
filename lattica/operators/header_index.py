"""Joins of similar strings and of similar lists of headers, without comparing all pairs.

Strings. Two strings of n and m characters of ratio t or more share a subsequence of at least t (n + m) / 2
characters, so at most a of the one's and b of the other's characters are outside it. Restrict both to the rarest
characters, in one order of rarity for all, until a + l (b + l) of their places are left: at least l of the shared ones
are left in the string with the smaller set of characters, and both restrictions hold them in the same order. So the
two strings share one of the subsequences of length l of these restrictions, which are their keys for this pair of
lengths. l is the least for which keys of unlike strings hardly meet, as far as the keys stay few.

Lists. The similarity of a list to another is the mean of its headers' best ratios. If a list of k headers reaches s,
then of any p of them one has a best ratio of 1 - (1 - s) k / p or more. So up to a quarter of a list's headers may be
left out of the look-up, and are where they are common ones, which so many lists share that a meeting says nothing.
Lists that meet by a header are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.similarity import indel_ratio_udf, normal_list_similarity_udf
from lattica.session import checkpointed

#: Characters that a place may hold, as good as equally often; wanted share of unlike strings that meet; most keys.
ALPHABET, MEET, KEYS = 12, 0.002, 800
#: Longer strings are told apart by classes of lengths, eight to a doubling, and have keys of one character.
LONG = 128
#: Headers in so many lists are common ones.
COMMON = 1000


@lru_cache(None)
def key_length(n: int, m: int, at_least: float) -> tuple[int, int, int] | None:
    """``(a, b, l)`` for strings of n and m characters; None where they cannot be similar enough."""
    shared = ceil(at_least * (n + m) / 2 - 1e-9)
    if shared > min(n, m):
        return None
    a, b = n - shared, m - shared
    length = 1
    for k in range(1, shared + 1):
        if k > 1 and comb(max(a, b) + k, k) > KEYS:
            break
        length = k
        if comb(a + k, k) * comb(b + k, k) / ALPHABET**k <= MEET:
            break
    return a, b, length


def length_class(n: int) -> int:
    return n if n <= LONG else LONG + 1 + int(8 * log2(n / LONG))


def partner_classes(n: int, at_least: float) -> dict[int, int]:
    """Length classes of strings that may be similar to one of n characters, with the least such length in each."""
    low, high = max(1, ceil(n * at_least / (2 - at_least) - 1e-9)), int(n * (2 - at_least) / at_least + 1e-9)
    out = {m: m for m in range(low, min(high, LONG) + 1)}
    m = max(low, LONG + 1)
    while m <= high:
        out[length_class(m)] = m
        of, up = length_class(m), max(m + 1, int(m * 1.08))
        while up > m + 1 and length_class(up - 1) > of:
            up -= 1
        while up <= high and length_class(up) == of:
            up += 1
        m = up
    return out


def subsequences(s: list[str], length: int) -> list[str]:
    """The distinct subsequences of one length; each is found once, at its leftmost places."""
    following: list[dict[str, int]] = [{}]
    for k in range(len(s) - 1, -1, -1):
        following.append({**following[-1], s[k]: k + 1})
    following.reverse()
    out, waiting = [], [("", 0)]
    while waiting:
        found, at = waiting.pop()
        left = length - len(found)
        if not left:
            out.append(found)
            continue
        waiting += [(found + c, to) for c, to in following[at].items() if len(s) - to >= left - 1]
    return out


def string_keys(s: str, rank: dict[str, int], at_least: float, second: bool = False) -> list[str]:
    """Keys of a string for each length that a partner may have; ``second`` for the join's second side."""
    made: dict[tuple[int, int], list[str]] = {}
    letters = sorted(set(s), key=lambda c: (rank.get(c, -1), c))
    out = []
    own = length_class(len(s))
    for other, m in partner_classes(len(s), at_least).items():
        if max(own, other) > LONG:
            outside, length = len(s) - ceil(at_least * (len(s) + m) / 2 - 1e-9), 1
        else:
            found = key_length(*((m, len(s)) if second else (len(s), m)), at_least)
            if found is None:
                continue
            outside, length = found[1 if second else 0], found[2]
        if (outside, length) not in made:
            kept: set[str] = set()
            places = 0
            for c in letters:
                kept.add(c)
                places += s.count(c)
                if places >= outside + length:
                    break
            made[outside, length] = subsequences([c for c in s if c in kept], length)
        lengths = f"{other},{own}" if second else f"{own},{other}"
        out += [f"{lengths}:{g}" for g in made[outside, length]]
    return out


def character_ranks(*sides: DataFrame) -> dict[str, int]:
    """Characters by rarity; there are as many as the alphabets of the headers have."""
    chars = [s.select(F.explode(F.split("s", "")).alias("c")) for s in sides]
    counts = chars[0]
    for more in chars[1:]:
        counts = counts.union(more)
    rows = counts.where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "c").collect()
    return {r["c"]: k for k, r in enumerate(rows)}


def _keyed(strings: DataFrame, rank: dict[str, int], at_least: float, second: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 64):  # a string may have some thousand keys
                some = batch.iloc[k : k + 64]
                yield pd.DataFrame({"s": some["s"], "keys": [string_keys(s, rank, at_least, second) for s in some["s"]]})

    keyed = strings.where("s <> ''").mapInPandas(run, "s string, keys array<string>")
    return keyed.select("s", F.explode("keys").alias("key")).select("s", F.xxhash64("key").alias("key"))


def met_strings(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """Pairs ``(x, y)`` of distinct strings ``left(s)`` and ``right(s)`` that share a key: those to compare."""
    rank = character_ranks(left, right)
    a, b = _keyed(left, rank, at_least, False), _keyed(right, rank, at_least, True)
    return a.select(F.col("s").alias("x"), "key").join(b.select(F.col("s").alias("y"), "key"), "key").select("x", "y").distinct()


def similar_strings(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """Pairs ``(x, y)`` of distinct strings of ratio ``at_least`` or more; equal ones, empty ones included, are similar."""
    near = met_strings(left, right, at_least).where("x <> y").where(indel_ratio_udf("x", "y") >= at_least - 1e-9)
    return near.union(left.join(right, "s").select(F.col("s").alias("x"), F.col("s").alias("y")))


def similar_lists(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """``(a, b, score)`` of ``left(a, ha)`` and ``right(b, hb)``, lists of normal headers, whose similarity, of the first
    to the second, is ``at_least`` or more. Each list should come once: equal lists are compared each on its own."""
    left, right = checkpointed(left), checkpointed(right)
    theirs = right.select("b", F.explode("hb").alias("y")).distinct()
    words = left.select("a", F.size("ha").alias("k"), F.explode("ha").alias("x"))
    rarity = theirs.groupBy("y").agg(F.count(F.lit(1)).alias("df"))
    known = words.join(rarity, F.col("x") == F.col("y"), "left").select("a", "k", "x", F.coalesce("df", F.lit(0)).alias("df"))
    place = F.row_number().over(W.partitionBy("a").orderBy(F.col("df").desc(), "x"))
    common = (F.col("df") > COMMON) & (F.col("place") <= F.floor(F.col("k") / 4))  # left out of the look-up
    kept = known.withColumn("place", place).where(~common)
    p = F.count(F.lit(1)).over(W.partitionBy("a"))
    kept = checkpointed(kept.withColumn("p", p).select("a", "x", F.when(F.col("p") < F.col("k"), 1 - (1 - at_least) * 4 / 3).otherwise(at_least).alias("ratio")).distinct())
    pairs = None
    for ratio in (at_least, 1 - (1 - at_least) * 4 / 3):  # p is three quarters of k at least
        own = kept.where(F.abs(F.col("ratio") - ratio) < 1e-9)
        if pairs is not None and own.isEmpty():
            continue
        near = similar_strings(own.select(F.col("x").alias("s")).distinct(), theirs.select(F.col("y").alias("s")).distinct(), ratio)
        met = own.join(near, "x").join(theirs, "y").select("a", "b")
        pairs = met if pairs is None else pairs.union(met)
    both = pairs.distinct().join(left, "a").join(right, "b").withColumn("score", normal_list_similarity_udf("ha", "hb"))
    return both.where(F.col("score") >= at_least - 1e-12).select("a", "b", "score")
