"""SimHash near-duplicate detection with bit-sliced comparison (operator 1).

A document's fingerprint is the bitwise majority of the 64-bit hashes of its word shingles. Fingerprints at
Hamming distance ``radius`` or less are linked; a component is one class of near copies.

Plan
1. ``fingerprints``: one Arrow pass over the texts; equal fingerprints collapse to one row with their
   smallest document, by a grouped minimum, so a class of exact copies is one row however large.
2. Pigeonhole keys: of ``radius + 1`` parts of the bits two linked fingerprints share at least one, so every
   link meets in a bucket. A bucket above ``bucket_rows`` is dealt again by the same rule over the bits that
   its key does not hold yet; buckets therefore stay bounded and no link is lost. With ``radius`` or fewer
   bits left, at most ``2 ** radius`` fingerprints can remain.
3. Inside a bucket the fingerprints are stored vertically, as 64 bit planes of 64 lanes a word. A fingerprint
   is compared with a whole block at once: each plane is XORed with its bit, and the difference bits run
   through carry-save counters. Once all lanes of a block exceed the radius, the block is abandoned.
   A bucket hands on a spanning forest of its links, never all pairs.
4. Components of the links by alternating stars.

Defined cases: a null or empty text and a text without a word have fingerprint zero and link like any other;
repeated rows of a document give repeated rows out; a null doc_id is kept and is the smallest of its class only
if no other id is there; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import bounded_batches, connected_components, materialize, read, spare_memory

_UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of A-Z-lower-cased words; fewer words than ``shingle``: the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER_TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*(words[i:] for i in range(shingle)))
    return np.fromiter((digest(join(g), seed) for g in grams), np.uint64, len(words) - shingle + 1)


def majority_fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit number whose bit is 1 where over half the hashes have a 1; 0 for no hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        for batch in batches:
            fps = [majority_fingerprint(shingle_hashes(t.as_py(), shingle, seed)) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


# --- bit-sliced comparison -----------------------------------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 planes x words; lane j of word w of plane p is bit p of fingerprint 64 w + j (missing lanes 0)."""
    words = -(-len(fps) // 64)
    padded = np.zeros(words * 64, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").reshape(64, words)


def lanes_within(queries: np.ndarray, planes: np.ndarray, word_of: np.ndarray, candidates: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare ``queries[i]`` with the 64 lanes of plane word ``word_of[i]``, all at once.

    ``candidates[i]`` has a 1 for each lane that counts. Returns the rows that still have a lane within
    ``radius`` and the masks of those lanes. Counters are kept bit-sliced: ``ones, twos, ...`` hold one binary
    digit of every lane's distance; ``over`` is set for good once a lane exceeds the radius.
    """
    digits = max(1, (radius + 1).bit_length())
    rows = np.flatnonzero(candidates)
    over = ~candidates[rows]
    counter = [np.zeros(len(rows), np.uint64) for _ in range(digits)]
    limit = radius + 1
    for plane in range(64):
        bit = (queries[rows] >> np.uint64(plane)) & _ONE
        carry = planes[plane, word_of[rows]] ^ (np.uint64(0) - bit)
        for d in range(digits):
            counter[d], carry = counter[d] ^ carry, counter[d] & carry
        reached = ~np.zeros_like(over)
        for d in range(digits):
            reached &= counter[d] if limit >> d & 1 else ~counter[d]
        over |= reached
        if plane % 8 == 7:  # abandon the blocks whose lanes all exceed the radius
            alive = over != _ALL
            if not alive.all():
                rows, over = rows[alive], over[alive]
                counter = [c[alive] for c in counter]
                if not len(rows):
                    break
    return rows, ~over


def _pairs(rows: np.ndarray, masks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, lane = np.nonzero(bits)
    return rows[i], first[i] + lane


def links_in_block(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of rows with equal key and distance at most ``radius``; rows are sorted by key.

    The pairs come in portions. Buckets of up to 64 rows are laid side by side into words that none straddles.
    """
    n = len(fps)
    if n < 2:
        return
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, n])
    small = (size > 1) & (size <= 64)
    if small.any():
        s, z = start[small], size[small]
        lane, word, at = np.empty(len(z), np.int64), np.empty(len(z), np.int64), 0
        free = 64
        for k, need in enumerate(z.tolist()):
            if need > free:
                at, free = at + 1, 64
            lane[k], word[k] = 64 - free, at
            free -= need
        within = np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)
        row = np.repeat(s, z) + within
        slot = np.repeat(word * 64 + lane, z) + within
        laid, back = np.zeros((at + 1) * 64, np.uint64), np.zeros((at + 1) * 64, np.int64)
        laid[slot], back[slot] = fps[row], row
        top = np.repeat(lane + z, z).astype(np.uint64)
        upto = np.where(top == 64, _ALL, (_ONE << (top % np.uint64(64))) - _ONE)
        mine = (slot % 64 + 1).astype(np.uint64)
        below = np.where(mine == 64, _ALL, (_ONE << (mine % np.uint64(64))) - _ONE)
        planes = bit_planes(laid)
        for a in range(0, len(row), 1 << 17):
            b = slice(a, a + (1 << 17))
            got, masks = lanes_within(fps[row[b]], planes, slot[b] // 64, upto[b] & ~below[b], radius)
            q, other = _pairs(got, masks, (slot[b] // 64 * 64)[got])
            yield row[b][q], back[other]
    for s, z in zip(start[size > 64].tolist(), size[size > 64].tolist()):
        planes = bit_planes(fps[s : s + z])
        words = planes.shape[1]
        last = _ALL if z % 64 == 0 else (_ONE << np.uint64(z % 64)) - _ONE
        for a in range(0, z, 256):
            q = np.arange(a, min(a + 256, z))
            word_of = np.tile(np.arange(words), len(q))
            who = np.repeat(q, words)
            shift = np.clip(who + 1 - word_of * 64, 0, 64)
            mask = np.where(shift >= 64, np.uint64(0), _ALL << np.minimum(shift, 63).astype(np.uint64))
            mask[word_of == words - 1] &= last
            got, masks = lanes_within(fps[s + who], planes, word_of, mask, radius)
            i, other = _pairs(got, masks, (word_of * 64)[got])
            yield s + who[i], s + other


def spanning_links(n: int, portions: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest node it is linked with directly or not, within these links."""
    root = np.arange(n)
    for i, j in portions:
        while len(i):
            a, b = root[i], root[j]
            live = a != b
            if not live.any():
                break
            i, j, a, b = i[live], j[live], a[live], b[live]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


# --- candidate buckets ---------------------------------------------------------------------------------


def _parts(bits: tuple[int, ...], parts: int) -> list[tuple[int, ...]]:
    cut = [len(bits) * k // parts for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def _gather(fp: Column, bits: tuple[int, ...]) -> Column:
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def near_links(nodes: DataFrame, radius: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """Links ``(a, b)``, ids of ``nodes(id, fp)`` (distinct fp): a spanning forest of each bucket's links."""
    parts = radius + 1

    def dealt(df: DataFrame, held: tuple[int, ...], free: tuple[int, ...]) -> DataFrame:
        """One row per part of the free bits, keyed by the held bits and that part."""
        keys = [
            F.struct(F.lit(",".join(map(str, sorted(held + p)))).alias("bits"), _gather(F.col("fp"), held + p).alias("value"))
            for p in _parts(free, parts)
        ]
        return df.select("id", "fp", F.explode(F.array(*keys)).alias("k")).select("id", "fp", "k.bits", "k.value")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def solve(key: np.ndarray, fp: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            root = spanning_links(len(fp), links_in_block(key, fp, radius))
            own = np.flatnonzero(root != np.arange(len(fp)))
            return pa.record_batch([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"])

        for batch in batches:  # sorted by key: all but the last bucket are complete
            key, fp, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            if not len(key):
                continue
            held.append((key, fp.view(np.uint64), ids))
            if key[0] == key[-1] and len(held) > 1 and held[0][0][0] == key[0]:
                continue
            key, fp, ids = (np.concatenate(x) for x in zip(*held))
            cut = np.searchsorted(key, key[-1])
            held = [(key[cut:], fp[cut:], ids[cut:])]
            if cut:
                yield solve(key[:cut], fp[:cut], ids[:cut])
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    def compared(rows: DataFrame) -> DataFrame:
        keyed = rows.select(F.xxhash64("bits", "value").alias("key"), "fp", "id")
        return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")

    found, todo = None, [(nodes, (), tuple(range(64)))]
    while todo:
        following: list = []
        for df, held, free in todo:
            rows = dealt(df, held, free)
            hot = rows.groupBy("bits", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("bits", "value")
            hot = materialize(hot, "hot")
            if len(free) > parts and not hot.isEmpty():
                links = compared(rows.join(hot, ["bits", "value"], "left_anti"))
                again = materialize(rows.join(hot, ["bits", "value"], "left_semi"), "again")
                for p in _parts(free, parts):
                    name = ",".join(map(str, sorted(held + p)))
                    following.append((again.where(F.col("bits") == name).select("id", "fp"), held + p, tuple(b for b in free if b not in p)))
            else:
                links = compared(rows)
            found = links if found is None else found.union(links)
        todo = following
    return found


def near_dedup(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, bucket_rows: int = 4096) -> DataFrame:
    """``(doc_id, fingerprint, component_id, kept)`` for every row of ``docs(doc_id, text)``."""
    fps = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    parts = connected_components(near_links(nodes.where("id IS NOT NULL"), radius, bucket_rows))
    of_fp = nodes.join(parts, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = fps.join(of_fp, "fp")
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy classes of all ``documents``: 3-word shingles, XXH64 seed 42, 3 differing bits or fewer."""
    return near_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))
