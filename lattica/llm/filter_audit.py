"""Filter interaction audit (operator 13): what each filter removes, in every order of the filters.

Scan. An Arrow buffer of texts is one array of bytes with offsets. Byte classes mark white space, capitals and symbols;
their prefix sums at the offsets give counts per document, and the places where a byte of a word follows one of none
give the words. Words are hashed by prefix sums of a polynomial modulo 2^64, sorted within their documents, and
neighbours of equal hash are compared byte by byte: where all agree, the changes of hash are the distinct words; a
document with a true collision is counted again by its words. Work arrays are bounded: bytes are hashed in runs of
whole words.

Copies. A document fails the copies filter where a smaller doc_id has the same text (by SHA-256). Documents are first
summed by text, part and labels (combined map-side, so a hot text is a row or two a task), with the least doc_id and the
documents that hold it; the least over all parts of a text comes from a window over those sums.

Reduction. What is left is a number of documents for each part, mask of failures and label: at most 128 rows a part.
All orders and steps follow from them: a filter removes at its step the masks that hold it and no earlier one.

Defined cases: a null text is empty; a null lang is the empty part; a null doc_id is no smaller than another, nor has
it smaller ones; repeated rows are documents of their own and not copies of each other; a document is good (toxic) if
any row of its labels says so, and neither without one; other columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import bounded_batches, read, spare_memory

#: Bytes that are hashed at once (a single longer word is hashed alone, in as many as it has).
RUN_BYTES = 1 << 18
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)

#: Filters by letter; each condition is over counts per document. The last letter is the copies filter.
FILTERS = {
    "A": lambda s: s["words"] < 200,
    "B": lambda s: 100 * s["distinct"] < 50 * s["words"],
    "C": lambda s: 100 * s["capitals"] > 3 * s["chars"],
    "D": lambda s: s["symbols"] > 0,
}
COPIES = "E"
SYMBOLS = b"#$%&*|"

_IS_SPACE, _IS_CAPITAL, _IS_SYMBOL, _IS_CHAR = (np.zeros(256, bool) for _ in range(4))
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IS_CAPITAL[ord("A") : ord("Z") + 1] = True
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_CHAR[:] = True
_IS_CHAR[0x80:0xC0] = False  # bytes that continue a character

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)]


def _powers(n: int, factor: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Powers of the multiplier; kept up to the size of a run."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n]
    with np.errstate(over="ignore"):
        made = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, RUN_BYTES) - 1, factor)]), dtype=np.uint64)
    if n <= RUN_BYTES:
        _POWERS[0] = made
    return made[:n]


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words, ``sum((byte + 1) * m^(n - 1 - place))``, by prefix sums over runs of whole words.

    In a run of L bytes a prefix sum weighs byte i by m^(L - 1 - i), so a word's share of it is its hash times
    m^(L - its end), which the inverse powers take away."""
    out = np.empty(len(begins), np.uint64)
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    k = 0
    with np.errstate(over="ignore"):
        while k < len(begins):
            to = max(k + 1, int(np.searchsorted(ends, begins[k] + RUN_BYTES, side="right")))
            first, last = int(begins[k]), int(ends[to - 1])
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * _powers(last - first)[::-1], out=sums[1:])
            b, e = begins[k:to] - first, ends[k:to] - first
            out[k:to] = (sums[e] - sums[b]) * _inverse_powers(last - first + 1, inverse)[last - first - e]
            k = to
    return out


_INVERSE: list[np.ndarray] = [np.ones(1, np.uint64)]


def _inverse_powers(n: int, inverse: np.uint64) -> np.ndarray:
    if len(_INVERSE[0]) >= n:
        return _INVERSE[0][:n]
    with np.errstate(over="ignore"):
        made = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, RUN_BYTES + 1) - 1, inverse)]), dtype=np.uint64)
    if n <= RUN_BYTES + 1:
        _INVERSE[0] = made
    return made[:n]


def _same_words(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the words that begin at ``a`` and ``b``, of equal lengths, have the same bytes."""
    out = np.ones(len(a), bool)
    k = 0
    while k < len(a):
        total = np.cumsum(lengths[k : k + RUN_BYTES])
        n = max(1, int(np.searchsorted(total, RUN_BYTES, side="right")))
        size, upto = lengths[k : k + n], total[:n]
        step = np.arange(int(upto[-1])) - np.repeat(upto - size, size)
        differ = data[np.repeat(a[k : k + n], size) + step] != data[np.repeat(b[k : k + n], size) + step]
        out[k : k + n] = np.add.reduceat(differ, upto - size) == 0  # words have a byte at least
        k += n
    return out


def distinct_words(data: np.ndarray, doc: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    """Distinct words of each document: sorted hashes, neighbours of equal hash verified."""
    order = np.lexsort((hashes, doc))
    d, h, b, e = doc[order], hashes[order], begins[order], ends[order]
    equal = np.flatnonzero((d[1:] == d[:-1]) & (h[1:] == h[:-1]))
    out = np.bincount(doc, minlength=n_docs) - np.bincount(d[equal], minlength=n_docs)
    lengths = e - b
    verified = lengths[equal] == lengths[equal + 1]
    at = equal[verified]
    verified[verified] = _same_words(data, b[at], b[at + 1], lengths[at])
    for k in np.unique(d[equal[~verified]]):  # a collision
        own = np.flatnonzero(doc == k)
        out[k] = len({data[x:y].tobytes() for x, y in zip(begins[own], ends[own])})
    return out


def text_counts(texts: pa.Array, hashed=word_hashes) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of each text; null is empty."""
    if texts.null_count:
        texts = pa.array(["" if t is None else t for t in texts.to_pylist()], texts.type)
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, values = texts.buffers()
    n = len(texts)
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
    at = at - at[0]

    def counted(of: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(of[data], dtype=np.int32 if len(data) < 1 << 31 else np.int64)])[at].astype(np.int64))

    word = np.zeros(len(data) + 1, bool)  # one more, so that a word may end with the buffer
    word[:-1] = ~_IS_SPACE[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    closes = ~word
    closes[1:] &= word[:-1]
    closes[0] = False
    edge = at[(at > 0) & (at < len(data))]  # a document's end also ends a word
    joined = edge[word[edge] & word[edge - 1]]
    opens[joined] = closes[joined] = True
    begins, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    doc = np.searchsorted(at, begins, side="right") - 1
    return {
        "words": np.bincount(doc, minlength=n),
        "distinct": distinct_words(data, doc, begins, ends, hashed(data, begins, ends), n),
        "capitals": counted(_IS_CAPITAL),
        "symbols": counted(_IS_SYMBOL),
        "chars": counted(_IS_CHAR),
    }


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(id, part, mask, digest)`` of every document; bit k of the mask is the k-th of ``FILTERS``."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        for batch in batches:
            texts = batch.column(2)
            counts = text_counts(texts)
            mask = sum(fails(counts).astype(np.int32) << k for k, fails in enumerate(FILTERS.values()))
            digests = [hashlib.sha256(t.as_buffer()).digest() for t in texts]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(mask, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, part string, mask int, digest binary")


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents by part, failures (copies included) and labels."""
    copies = 1 << len(FILTERS)
    known = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = scanned(docs).join(known, F.col("id") == F.col("label_id"), "left").select("id", "part", "mask", "digest", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    keys = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("id", *keys).agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null")
    )
    least = F.min("first").over(W.partitionBy("digest"))
    passing = F.col("n_null") + F.when(F.col("first") == least, F.col("n_first")).otherwise(0)
    split = by_text.withColumn("passing", passing)
    sums = split.groupBy("part", "mask", "good", "toxic").agg(F.sum("passing").alias("passing"), F.sum(F.col("n") - F.col("passing")).alias("failing"))
    both = F.inline(F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + copies).alias("mask"), F.col("failing").alias("n"))))
    return sums.select("part", "good", "toxic", both)


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(masks: DataFrame) -> DataFrame:
    """``AUDIT`` of ``failure_masks``: a row for every part, order of the filters and step."""
    letters = "".join(FILTERS) + COPIES
    entries = F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("entries")  # at most 128 a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        orders = ["".join(p) for p in permutations(letters)]
        bits = np.array([[1 << letters.index(x) for x in o] for o in orders])
        before = np.cumsum(bits, axis=1) - bits
        m = np.arange(1 << len(letters))
        own, earlier = (m & bits[..., None]) > 0, (m & before[..., None]) > 0
        removes, redundant, alone = own & ~earlier, own & earlier, m == bits[..., None]
        keeps = ~own & ~earlier
        for batch in batches:
            for part, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, good, toxic = (np.zeros(len(m), np.int64) for _ in range(3))
                for x in listed:
                    n[x["mask"]] += x["n"]
                    good[x["mask"]] += x["n"] * x["good"]
                    toxic[x["mask"]] += x["n"] * x["toxic"]
                removed = removes @ n
                shapley = np.zeros(1 << len(letters), np.int64)
                np.add.at(shapley, bits, removed)
                columns = [keeps @ n, removed, redundant @ n, alone @ n, removes @ good, removes @ toxic, shapley[bits]]
                yield pa.record_batch(
                    [
                        pa.array([part] * bits.size), pa.array(np.repeat(orders, bits.shape[1]).tolist()), pa.array(np.tile(np.arange(1, bits.shape[1] + 1, dtype=np.int32), len(orders))),
                        *(pa.array(c.ravel()) for c in columns),
                    ],
                    [c.split()[0] for c in AUDIT.split(", ")],
                )

    return masks.groupBy("part").agg(entries).mapInArrow(run, AUDIT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five filters over all documents: kept, removed, redundant, lost and shared out at each step."""
    return audit(failure_masks(read(spark, sf_dir, "documents", "doc_id", "lang", "text"), read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP13_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
s AS (SELECT *, CAST(len(words) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
    + 4 * CAST(100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INTEGER) AS mask FROM w),
k AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM s LEFT JOIN k USING (doc_id) GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e
  WHERE a.x <> b.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
p AS (SELECT filter_order, step, bits[step] AS b, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, b, sum(CASE WHEN mask & (before | b) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & b > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM g, p GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM r
"""
