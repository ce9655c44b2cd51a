"""Removal of repeated word windows by level-wise doubling (operator 8).

Every window of ``window`` consecutive words whose word sequence also starts in a document with a smaller id
marks its words for removal. Windows are judged on the input, all of them.

A window can only repeat across documents if the shorter windows in it do. So the levels are lengths that double, up
to the full one: of 13 words 7 and 13, of 50 words 7, 13, 25 and 50 (``levels``). On a level below the last each
candidate is judged by one window of that length in it, the one with the least hash (two equal full windows choose
equal ones, so none is missed; for 13 words about a quarter of the positions is chosen). Only candidates whose
chosen window repeats in another document are extended to the next level, of twice the length (less one, where that
is odd). On the last level the first document of a window decides. A batch without candidates sends nothing more.

What is moved, and how it stays small and even
* Documents are dealt into batches by a hash of their id, text and partition (so a row that is repeated very often
  is dealt out as well); the same exchange of the texts serves all passes.
* A batch sends one entry per distinct window hash, not per occurrence: a passage that a third of all documents
  share is one entry a batch. Entries go, sorted and packed, to the part that their hash names, so parts are
  even; an entry of a lower level is 4 bytes, of the last a 64-bit hash and the batch's smallest document.
* A part answers with one bit an entry, in the order of the entries it got. No rows are joined back by hash.
* The parts are named by a second hash, so hashes are only compared within their part.

Defined cases: a null text has no words; fewer words than the window: nothing is removed; equal doc_ids do not
remove from each other; a null doc_id counts as larger than any other; repeated windows inside one document
alone stay; repeated rows are judged each; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lattica.llm.common import bounded_batches, read, spare_memory

BATCH_BYTES, PART_BYTES = 4 << 20, 16 << 20
_NO_ID = np.int64(2**63 - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _F1
    x = (x ^ (x >> _S33)) * _F2
    return x ^ (x >> _S33)


def _doubled(h: np.ndarray, have: int, want: int) -> np.ndarray:
    """Hashes of windows of ``want`` words from those of ``have``, ``have < want <= 2 * have``."""
    return _mix(h[: len(h) - (want - have)] * _M1 + h[want - have :] * _M2)


def ladder(window: int) -> list[int]:
    """Lengths from ``window`` down to 1, each at most twice the one below."""
    steps = [window]
    while steps[-1] > 1:
        steps.append((steps[-1] + 1) // 2)
    return steps[::-1]


def _runs(same: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that equal their neighbours, from the places that equal the next."""
    for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1):
        if len(run):
            yield int(run[0]), int(run[-1]) + 2


def levels(window: int, least: int = 7) -> list[int]:
    """The lengths whose windows are exchanged: the doublings from ``least`` words, but at least half the window, up."""
    steps = ladder(window)
    return [s for s in steps if s >= min(least, (window + 1) // 2)]


class Batch:
    """Window hashes over the words of some documents, in the order of their ids; words are not held."""

    def __init__(self, ids: list, texts: pa.ChunkedArray, window: int, parts: int) -> None:
        self.window, self.parts, self.texts = window, parts, texts
        self.ids = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        # Rows may arrive in another order each time the batch is read; equal ids are told apart by their text.
        order = np.argsort(self.ids, kind="stable")
        same = np.flatnonzero(self.ids[order][1:] == self.ids[order][:-1])
        for begin, end in _runs(same):
            order[begin:end] = sorted(order[begin:end].tolist(), key=lambda k: texts[k].as_py() or "")
        self.order, self.ids = order, self.ids[order]
        digest = xxhash.xxh64_intdigest
        each = [np.fromiter(map(digest, words), np.uint64, len(words)) for words in self.words()]
        self.sizes = np.array([len(h) for h in each], np.int64)
        low = np.concatenate(each) if each else np.empty(0, np.uint64)
        del each
        total = len(low)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        #: Hashes of the windows of half the length; those of the whole are made where they are needed.
        steps = ladder(window)
        self.half = steps[-2] if len(steps) > 1 else 1
        self.hashes = [low]  # of single words; the lengths between are made again on the level that needs them
        self.low = self.of_length(self.half)
        starts = max(total - window + 1, 0)
        self.start = np.flatnonzero(self.doc[:starts] == self.doc[total - starts :]).astype(np.int32) if starts else np.empty(0, np.int32)

    def words(self) -> Iterator[list[bytes]]:
        """The words of each document."""
        for k in self.order.tolist():
            yield (self.texts[k].as_py() or "").encode("utf-8", "replace").split()

    def of_length(self, length: int) -> np.ndarray:
        """Hashes of the windows of a length on the ladder."""
        out, have = self.hashes[0], 1
        for want in ladder(self.window):
            if have < want <= length:
                out, have = _doubled(out, have, want) if len(self.hashes[0]) >= want else out[:0], want
        return out

    def chosen(self, length: int, candidate: np.ndarray) -> np.ndarray:
        """For each candidate window the least hash of the windows of ``length`` in it."""
        low, have = self.low if length == self.half else self.of_length(length), 1
        want = self.window - length + 1
        while have < want:
            step = min(have, want - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        return low[self.start[candidate]]

    def lower_level(self, length: int, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct entries (part in the upper, hash in the lower 32 bits), which of them two documents share
        here, and for each candidate window its entry."""
        chosen = self.chosen(length, candidate)
        key = ((chosen >> np.uint64(32)) % np.uint64(self.parts) << np.uint64(32)) | (chosen & np.uint64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")
        ranked, docs = key[order], self.doc[self.start[candidate]][order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(ranked)] - 1
        entry = np.empty(len(key), np.int64)
        entry[order] = np.repeat(np.arange(len(first)), last - first + 1)
        return ranked[first], docs[first] != docs[last] if len(first) else np.empty(0, bool), entry

    def last_level(self, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Part, hash and smallest document id of the distinct candidate windows, and each candidate's entry."""
        at = self.start[candidate]
        first, last = self.low[at], self.low[at + self.window - self.half]
        hashes = _mix(first * _M1 + last * _M2) if self.window > 1 else first
        second = _mix(first * _M2 + last * _F1)
        part = (second % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((hashes, part))  # stable: the first of equals lies in the smallest document
        h, p = hashes[order], part[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])] if len(h) else np.empty(0, bool)
        entry = np.empty(len(h), np.int64)
        entry[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return p[first], h[first], self.ids[self.doc[at][order][first]], entry


def _answers(part: np.ndarray, replies: pa.Table) -> np.ndarray:
    """One flag for each entry, from the packed bits of each part; entries are sorted by part."""
    flags = np.zeros(len(part), bool)
    for p, bits in zip(replies["p"].to_pylist(), replies["bits"].to_pylist()):
        if p >= 0:
            a, b = np.searchsorted(part, [p, p + 1])
            flags[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return flags


def _packed(part: np.ndarray, *columns: np.ndarray) -> list[list]:
    """The bytes of each column for each part that has entries, after the part itself."""
    names, at = np.unique(part, return_index=True)
    cut = [*at.tolist(), len(part)]
    return [names.tolist(), *([c[a:b].tobytes() for a, b in zip(cut, cut[1:])] for c in columns)]


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept_text`` (kept words joined by one space), ``n_words`` and ``n_removed``; like names give way."""
    made = ["kept_text", "n_words", "n_removed"]
    names = [c for c in docs.columns if c not in made]
    bounded_batches(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))), F.lit(0))).first()[0]
    steps = levels(window)
    batches, parts = max(1, total // BATCH_BYTES), max(1, total // PART_BYTES)
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    batch = F.pmod(F.xxhash64(F.col(key), F.col(text), F.spark_partition_id()), F.lit(int(batches)))
    dealt = plain.withColumn("b", batch)
    entries, reply = "p int, b long, keys binary, docs binary", "b long, p int, bits binary"

    def batch_of(table: pa.Table) -> Batch:
        spare_memory()
        return Batch(table[key].to_pylist(), table[text], window, parts)

    def sent(b: int, p: list, keys: list, ids: list) -> pa.Table:
        return pa.table({"p": pa.array(p, pa.int32()), "b": pa.array([b] * len(p), pa.int64()), "keys": pa.array(keys, pa.binary()), "docs": pa.array(ids, pa.binary())})

    def ask(own: Batch, b: int, length: int, candidate: np.ndarray | None) -> pa.Table:
        """The entries of the candidates (None: of all windows) on a level."""
        candidate = np.ones(len(own.start), bool) if candidate is None else candidate
        if length == window:
            part, hashes, ids, _ = own.last_level(candidate)
            return sent(b, *_packed(part, hashes, ids))
        keys, _, _ = own.lower_level(length, candidate)
        p, packed = _packed((keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32))
        return sent(b, p, packed, [None] * len(p))

    def note(b: int, candidate: np.ndarray) -> pa.Table:
        """The batch's candidates, for itself: comes back with the answers."""
        return sent(b, [-1 - b % parts], [np.packbits(candidate).tobytes()], [None])

    def noted(own: Batch, replies: pa.Table) -> np.ndarray:
        found = [x for p, x in zip(replies["p"].to_pylist(), replies["bits"].to_pylist()) if p < 0]
        return np.unpackbits(np.frombuffer(found[0], np.uint8), count=len(own.start)).astype(bool) if found else np.ones(len(own.start), bool)

    def first(group: tuple, table: pa.Table) -> pa.Table:
        return ask(batch_of(table), group[0].as_py(), steps[0], None)

    def answered(rows: pa.Table, arrays: list[np.ndarray], flags: np.ndarray) -> pa.Table:
        cut = np.cumsum([0, *map(len, arrays)])
        bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
        return pa.table({"b": rows["b"].combine_chunks(), "p": rows["p"].combine_chunks(), "bits": pa.array(bits, pa.binary())})

    def parted(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
        """The entries, and the notes as they are."""
        mine = [p < 0 for p in rows["p"].to_pylist()]
        notes = rows.filter(pa.array(mine))
        kept = pa.table({"b": notes["b"].combine_chunks(), "p": notes["p"].combine_chunks(), "bits": notes["keys"].combine_chunks()})
        return rows.filter(pa.array([not m for m in mine])), kept

    def answer_lower(rows: pa.Table) -> pa.Table:
        """Whether another batch has the entry as well."""
        rows, kept = parted(rows)
        if not rows.num_rows:
            return kept
        arrays = [np.frombuffer(k, np.uint32) for k in rows["keys"].to_pylist()]
        keys = np.concatenate(arrays)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        flags = np.zeros(len(keys), bool)
        flags[order] = np.r_[False, same] | np.r_[same, False]
        return pa.concat_tables([answered(rows, arrays, flags), kept])

    def extend(length: int, following: int):
        """Candidates that survive ``length`` ask on the level of ``following``."""

        def run(group: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
            own, b = batch_of(table), group[0].as_py()
            candidate = noted(own, replies)
            keys, shared, entry = own.lower_level(length, candidate)
            survives = shared | _answers((keys >> np.uint64(32)).astype(np.int64), replies)
            candidate[candidate] = survives[entry]
            return pa.concat_tables([ask(own, b, following, candidate), note(b, candidate)])

        return run

    def answer_last(rows: pa.Table) -> pa.Table:
        """Whether a batch has the window in a document smaller than all of the asking batch's."""
        rows, kept = parted(rows)
        if not rows.num_rows:
            return kept
        arrays = [np.frombuffer(k, np.uint64) for k in rows["keys"].to_pylist()]
        keys, ids = np.concatenate(arrays), np.concatenate([np.frombuffer(d, np.int64) for d in rows["docs"].to_pylist()])
        order = np.lexsort((ids, keys))
        k, i = keys[order], ids[order]
        new = np.r_[True, k[1:] != k[:-1]]
        flags = np.empty(len(k), bool)
        flags[order] = i > i[np.flatnonzero(new)][np.cumsum(new) - 1]
        return pa.concat_tables([answered(rows, arrays, flags), kept])

    def finish(group: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        own = batch_of(table)
        candidate = noted(own, replies)
        part, _, smallest, entry = own.last_level(candidate)
        before = _answers(part, replies)[entry]
        at = own.start[candidate]
        at = at[before | (own.ids[own.doc[at]] > smallest[entry])]
        edge = np.zeros(len(own.doc) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        texts, removed, begin = [], [], 0
        for words in own.words():
            out = gone[begin : begin + len(words)]
            begin += len(words)
            removed.append(int(out.sum()))
            left = [w for w, g in zip(words, out.tolist()) if not g] if removed[-1] else words
            texts.append(b" ".join(left).decode("utf-8"))
        rows = table.select([f"c{k}" for k in range(len(names))]).take(pa.array(own.order))
        for name, column in zip(made, (pa.array(texts, pa.string()), pa.array(own.sizes), pa.array(removed, pa.int64()))):
            rows = rows.append_column(name, column)
        return rows

    out = dealt.groupBy("b").applyInArrow(first, entries)
    for length, following in zip(steps, steps[1:]):
        replies = out.groupBy("p").applyInArrow(answer_lower, reply)
        out = dealt.groupBy("b").cogroup(replies.groupBy("b")).applyInArrow(extend(length, following), entries)
    last = out.groupBy("p").applyInArrow(answer_last, reply)
    schema = StructType([*plain.schema.fields, StructField(made[0], StringType()), StructField(made[1], LongType()), StructField(made[2], LongType())])
    out = dealt.groupBy("b").cogroup(last.groupBy("b")).applyInArrow(finish, schema)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), *made)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows of all ``documents`` that start in a smaller document are removed."""
    out = remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
x AS (SELECT *, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS s FROM t),
f AS (SELECT s, min(doc_id) AS first FROM x WHERE i <= n - 12 GROUP BY s),
m AS (SELECT x.doc_id, x.w, x.i, i <= n - 12 AND first < doc_id AS starts FROM x LEFT JOIN f USING (s)),
g AS (SELECT doc_id, w, i, coalesce(bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM m),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
