"""SimHash near copies by similarity, with wide fingerprints (operator 1, for corpora rather than for its digest).

At 64 bits a radius that admits a shingle similarity of 0.8 would be some ten bits: too noisy to decide by, and
too wide to cut into parts that agree. Here a fingerprint has 128 bits, and its distance estimates the cosine of
two documents' shingle counts within a few hundredths; ``radius_of`` gives the distance of a similarity.

Candidates meet in buckets: a key is made of ``ROWS_A_BAND`` least hashes of the shingle set (MinHash), and two
documents of similarity 0.8 agree in one of ``BANDS`` keys with a chance of 0.9998 (1 - (1 - 0.8^4)^16). In a bucket
the fingerprints are compared bit-sliced as in ``simhash``: planes stored vertically, carry-save counters, blocks
abandoned once all lanes exceed the radius. The radius is four standard deviations above the distance of the
similarity, so it costs next to no pair; it spares the comparison of most pairs that met by chance. A bucket above
``bucket_rows`` is dealt as pairs of blocks: no pair in it is skipped.

What meets is a candidate only. The candidates' components are dealt to blocks with the shingle sets of their texts,
and a pair becomes a link where the Jaccard similarity of its two sets is ``SIMILARITY`` or more (``verified_links``).
A component of more than ``BLOCK_SHINGLES`` shingles or ``BLOCK_ROWS`` texts is dealt as pairs of blocks, one of more
than ``SPLIT`` blocks to the buckets that its texts met in, so chains of candidates cost no more than their texts.

Equal shingle sets are one node, so a class of exact copies is one row. Cases are defined as in ``simhash``; texts
without a word share the empty set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bounded_batches, connected_components, materialize, spare_memory
from lattica.llm.simhash import _pairs, shingle_hashes, spanning_links

SHINGLE, SIMILARITY, BUCKET_ROWS = 5, 0.8, 4096
BANDS, ROWS_A_BAND = 16, 4
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 20, 4096
#: Components of more blocks are compared bucket by bucket; a text has ``BANDS`` buckets.
SPLIT = BANDS
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)
#: Odd multipliers, each an order of the shingles' hashes.
_ORDERS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS_A_BAND, dtype=np.uint64) * np.uint64(2) + _ONE
#: Odd multipliers that make the further 64 bits of a shingle's hash.
_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def radius_of(similarity: float, bits: int = 128, slack: float = 4.0) -> int:
    """The distance of two documents of this Jaccard similarity, and ``slack`` standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + slack * math.sqrt(bits * share * (1 - share)))


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two words of 64 majority bits, as signed longs."""
    words = []
    for spread in _SPREAD:
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
            h = hashes[at : at + (1 << 16)] * spread
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        words.append(int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True))
    return words[0], words[1]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: a hash of the least hashes of the set under the band's orders."""
    least = np.full(len(_ORDERS), _ALL)
    for at in range(0, len(hashes), 256):  # bounded memory for very long texts
        h = hashes[at : at + 256]
        least = np.minimum(least, np.multiply.outer(h ^ (h >> np.uint64(32)), _ORDERS).min(0))
    return np.array([xxhash.xxh64_intdigest(band.tobytes()) for band in least.reshape(BANDS, ROWS_A_BAND)], np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, n, fp0, fp1, bands)`` of every row: digest and size of its shingle set, its fingerprint and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        for batch in batches:
            digests, sizes, fps, bands = [], [], [], []
            for t in batch.column(1):
                own = shingle_set(t.as_py(), shingle)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                fps.append(wide_fingerprint(own))
                bands.append(band_keys(own))
            a, b = (pa.array([f[k] for f in fps], pa.int64()) for k in (0, 1))
            keys = pa.array(bands, pa.list_(pa.int64()))
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), a, b, keys]
            yield pa.record_batch(columns, ["doc_id", "digest", "n", "fp0", "fp1", "bands"])

    made = "doc_id long, digest binary, n long, fp0 long, fp1 long, bands array<long>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, made)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """``bits x words`` planes of ``n x k`` fingerprint words, 64 lanes a word."""
    words = -(-len(fps) // 64)
    padded = np.zeros((words * 64, fps.shape[1]), "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").reshape(-1, words)


def lanes_within(queries: np.ndarray, planes: np.ndarray, word_of: np.ndarray, candidates: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``queries`` with a lane within ``radius`` in their word of planes, and the masks of those lanes."""
    digits = (radius + 1).bit_length()
    limit = radius + 1
    rows = np.flatnonzero(candidates)
    over = ~candidates[rows]
    counter = [np.zeros(len(rows), np.uint64) for _ in range(digits)]
    for plane in range(len(planes)):
        bit = (queries[rows, plane >> 6] >> np.uint64(plane & 63)) & _ONE
        carry = planes[plane, word_of[rows]] ^ (np.uint64(0) - bit)
        for d in range(digits):
            counter[d], carry = counter[d] ^ carry, counter[d] & carry
        if plane < radius:
            continue  # no lane can exceed the radius yet
        reached = counter[0] if limit & 1 else ~counter[0]
        for d in range(1, digits):
            reached = reached & (counter[d] if limit >> d & 1 else ~counter[d])
        over |= reached
        if plane % 8 == 7:
            alive = over != _ALL
            if not alive.all():
                rows, over = rows[alive], over[alive]
                counter = [c[alive] for c in counter]
                if not len(rows):
                    break
    return rows, ~over


def links_in_buckets(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of rows sorted by key that share it and lie within the radius.

    Rows are laid out in the order of their keys; each is compared with the words that its bucket reaches behind it.
    """
    n = len(fps)
    if n < 2:
        return
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    stop = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n]))
    planes = planes_of(fps)
    rows = np.flatnonzero(stop - np.arange(n) > 1)
    step = 0
    while len(rows):
        word = rows // 64 + step
        low = np.maximum(rows + 1, word * 64) - word * 64
        high = np.minimum(stop[rows], word * 64 + 64) - word * 64
        for at in range(0, len(rows), 1 << 16):
            part = slice(at, at + (1 << 16))
            lo, hi = low[part].astype(np.uint64), high[part]
            above = np.where(lo >= 64, np.uint64(0), _ALL << np.minimum(lo, np.uint64(63)))
            below = np.where(hi >= 64, _ALL, (_ONE << np.clip(hi, 0, 63).astype(np.uint64)) - _ONE)
            mask = np.where(hi > 0, above & below, np.uint64(0))
            got, found = lanes_within(fps[rows[part]], planes, word[part], mask, radius)
            i, j = _pairs(got, found, (word[part] * 64)[got])
            yield rows[part][i], j
        step += 1
        rows = rows[(rows // 64 + step) * 64 < stop[rows]]


def similar_links(nodes: DataFrame, radius: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Candidates ``(a, b)`` among ``nodes(id, fp0, fp1, bands)``: a spanning forest of those in each bucket."""
    rows = nodes.select("id", "fp0", "fp1", F.posexplode("bands").alias("band", "value"))
    rows = rows.select("id", "fp0", "fp1", F.xxhash64("band", "value").alias("key"))
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    hot = materialize(hot.select("key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("k")), "hot")
    if hot.isEmpty():
        rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        blocks = F.coalesce("k", F.lit(1))
        rows = rows.join(hot, "key", "left").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns key, fp0, fp1, id

        def solve(x: np.ndarray) -> pa.RecordBatch:
            fps = np.ascontiguousarray(x[:, 1:3]).view(np.uint64)
            root = spanning_links(len(x), links_in_buckets(x[:, 0], fps, radius))
            own = np.flatnonzero(root != np.arange(len(x)))
            return pa.record_batch([pa.array(x[own, 3]), pa.array(x[root[own], 3])], ["a", "b"])

        for batch in batches:  # sorted by key: all but the last bucket are complete
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)], 1))
            if held[0][0, 0] == held[-1][-1, 0]:
                continue
            x = np.concatenate(held)
            cut = int(np.searchsorted(x[:, 0], x[-1, 0]))
            held = [x[cut:]]
            yield solve(x[:cut])
        if held:
            yield solve(np.concatenate(held))

    keyed = rows.select(F.xxhash64("key", "i", "j").alias("key"), "fp0", "fp1", "id")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def links_of_sets(flat: np.ndarray, start: np.ndarray, fps: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """For each set the smallest row it is linked with, directly or not; set k is ``flat[start[k]:start[k + 1]]``, sorted.

    Every pair within the radius that no link joins yet is compared, whole set with whole set.
    """
    size = np.diff(start)
    n = len(size)
    root = np.arange(n)
    for q in range(n - 1):
        later = slice(q + 1, n)
        low, high = np.minimum(size[later], size[q]), np.maximum(size[later], size[q])
        far = np.bitwise_count(fps[later] ^ fps[q]).sum(1, dtype=np.int64)
        other = q + 1 + np.flatnonzero((root[later] != root[q]) & (low > 0) & (low >= similarity * high - 1e-6) & (far <= radius))
        if not len(other):
            continue
        own = flat[start[q] : start[q + 1]]
        first = np.cumsum(size[other]) - size[other]
        values = flat[np.arange(size[other].sum()) + np.repeat(start[other] - first, size[other])]
        hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        common = np.add.reduceat(hit, first, dtype=np.int64)
        linked = other[common / (size[q] + size[other] - common) >= similarity]
        joined = np.unique(np.r_[root[q], root[linked]])
        if len(joined) > 1:
            root[np.isin(root, joined)] = joined[0]
    return root


def dealt(members: DataFrame, block_shingles: int = BLOCK_SHINGLES, block_rows: int = BLOCK_ROWS, split: int = SPLIT) -> DataFrame:
    """``(id, places)`` of ``members(id, n, component, bands)``: the groups ``(component, key, k)`` that each text is compared
    in, each of ``k`` blocks.

    A component of up to ``split`` blocks is one group. A larger one, where candidates may have chained, is dealt to
    the buckets in which they met, so what is compared grows with its texts and not with the square of its blocks."""
    share = F.greatest(F.sum("n") / block_shingles, F.count(F.lit(1)) / block_rows)
    wide = members.groupBy("component").agg(F.ceil(share).cast("int").alias("k")).where(F.col("k") > split).select("component", F.lit(True).alias("wide"))
    keys = F.transform("bands", lambda v, band: F.xxhash64(band.cast("int"), v))
    groups = members.join(wide, "component", "left").withColumn("key", F.explode(F.when(F.col("wide"), keys).otherwise(F.array(F.lit(0).cast("long")))))
    sizes = groups.groupBy("component", "key").agg(F.ceil(share).cast("int").alias("k"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    places = groups.select("id", "component", "key").join(sizes, ["component", "key"])
    return places.groupBy("id").agg(F.collect_set(F.struct("component", "key", "k")).alias("places"))  # as many as bands at most


def verified_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, radius: int, shingle: int = SHINGLE, similarity: float = SIMILARITY, block_shingles: int = BLOCK_SHINGLES, block_rows: int = BLOCK_ROWS, split: int = SPLIT) -> DataFrame:
    """Links ``(a, b)`` of texts whose shingle sets have the Jaccard similarity, within ``candidates(id, component)``."""
    members = materialize(nodes.join(candidates, "id").select("id", "n", "component", "bands"), "members")
    found = materialize(dealt(members, block_shingles, block_rows, split), "dealt")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(found.select("id"), "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                own = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
                fps = [wide_fingerprint(s) for s in own]
                a, b = (pa.array([f[k] for f in fps], pa.int64()) for k in (0, 1))
                packed = pa.array([s.astype("<u8").tobytes() for s in own], pa.binary())
                yield pa.record_batch([batch.column(0), a, b, packed], ["id", "fp0", "fp1", "packed"])

    rows = texts.select("id", "text").mapInArrow(sets, "id long, fp0 long, fp1 long, packed binary").join(found, "id")
    rows = rows.withColumn("place", F.explode("places")).select("id", "fp0", "fp1", "packed", "place.*")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.where("k = 1 OR own <> other").withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        key, held = None, []

        def solve() -> pa.RecordBatch:
            ids = np.array([h[0] for h in held], np.int64)
            fps = np.array([h[1:3] for h in held], np.int64).view(np.uint64)
            start = np.cumsum([0, *(len(h[3]) // 8 for h in held)])
            flat = np.frombuffer(b"".join(h[3] for h in held), "<u8")
            root = links_of_sets(flat, start, fps, radius, similarity)
            own = np.flatnonzero(root != np.arange(len(held)))
            return pa.record_batch([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"])

        for whole in batches:  # sorted by key: a block is complete where the key changes
            for at in range(0, whole.num_rows, 512):
                columns = (c.to_pylist() for c in whole.slice(at, 512).columns)
                for own, *row in zip(*columns):
                    if own != key:
                        if len(held) > 1:
                            yield solve()
                        key, held = own, []
                    held.append(row)
        if len(held) > 1:
            yield solve()

    keyed = rows.select(F.xxhash64("component", "key", "i", "j").alias("key"), "id", "fp0", "fp1", "packed")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def similar_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, component_id, kept)`` for every row of ``docs(doc_id, text)``; the smallest document of a class is kept."""
    bounded_batches(docs.sparkSession)
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("digest", "n", "fp0", "fp1", "bands").agg(F.min("doc_id").alias("id")), "nodes")
    named = nodes.where("id IS NOT NULL")
    candidates = connected_components(similar_links(named, radius_of(similarity), bucket_rows))
    links = verified_links(docs, named, candidates, radius_of(similarity), shingle, similarity)
    of_set = nodes.join(connected_components(links), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = fps.join(of_set, "digest")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "component_id", kept.alias("kept"))
