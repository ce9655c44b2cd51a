"""Token counts under a unigram model by trie-shared dynamic programming (operator 3).

A text's tokens are those of its best segmentation under a unigram model: each piece that the pre-tokenizer
cuts off is split into vocabulary tokens of least total cost, ties to fewer tokens. The forward score of a
prefix depends on that prefix alone, so pieces that share a prefix share its scores. The distinct pieces of a
batch are walked in sorted order, which is the depth-first order of their trie: going from one piece to the
next keeps the scores up to the branching node and computes only the new edges. At a piece's terminal its
token count is stored, and documents add up stored counts.

The vocabulary is that of a public byte-level tokenizer; no tokenizer is trained. Its probabilities are an input
(``costs``). Without one, rank r has Zipf's probability 1 / ((r + 1) H), H the sum that makes them add up to one, so
its cost is ln(r + 1) + ln H, in fixed point for results that do not depend on the order of additions.
``fitted_costs`` estimates them from a whole corpus: one more step of hard expectation maximisation counts the tokens
of all its best segmentations, on Spark, and what reaches the driver is one number a token.

Defined cases: a null or empty text has 0 tokens; very long pieces take time in proportion to their length;
repeated rows give repeated rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lattica.llm.bpe import _PLAIN, _UNSAFE, chunks, load_ranks
from lattica.llm.common import bounded_batches, keeps_cache, read, spare_memory

#: Most words whose count a worker keeps, in two halves of which the older goes first (some 40 MB).
CACHE_WORDS = 400_000
FIXED_POINT = 1 << 20


def zipf_costs(n: int) -> list[int]:
    norm = math.log(math.fsum(1 / (r + 1) for r in range(n)))
    return [round(FIXED_POINT * (math.log(r + 1) + norm)) for r in range(n)]


class TrieCounter:
    """Least-cost token counts of pieces of text."""

    def __init__(self, tokens: list[bytes], costs: list[int], pattern: str = public_tokenizers.PATTERN) -> None:
        #: A trie of the reversed tokens: for each node its edges by byte, and the cost of the token that ends there.
        self.edges: list[dict[int, int]] = [{}]
        self.cost: list[int] = [-1]
        for token, cost in zip(tokens, costs):
            at = 0
            for byte in reversed(token):
                to = self.edges[at].get(byte)
                if to is None:
                    to = self.edges[at][byte] = len(self.edges)
                    self.edges.append({})
                    self.cost.append(-1)
                at = to
            if token:
                self.cost[at] = cost
        self.cut = regex.compile(pattern)
        self.at_spaces = pattern == public_tokenizers.PATTERN
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}  # the half of them that was filled before

    def terminal_counts(self, pieces: Iterable[bytes]) -> dict[bytes, tuple[int, int]]:
        """``(cost, tokens)`` of each distinct piece; forward scores once per node of their trie."""
        edges, cost, root = self.edges, self.cost, self.edges[0]
        best, count, before, out = [0], [0], b"", {}
        for piece in sorted(set(pieces)):
            shared, most = 0, min(len(before), len(piece))
            while shared < most and before[shared] == piece[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared, len(piece)):
                node, low, few, begin = root, -1, 0, end
                while begin >= 0:
                    to = node.get(piece[begin])
                    if to is None:
                        break
                    own = cost[to]
                    if own >= 0:
                        own += best[begin]
                        if own < low or low < 0 or (own == low and count[begin] + 1 < few):
                            low, few = own, count[begin] + 1
                    node = edges[to]
                    begin -= 1
                if low < 0:
                    raise ValueError("the vocabulary lacks a single byte")
                best.append(low)
                count.append(few)
            out[piece] = (best[-1], count[-1])
            before = piece
        return out

    def segment(self, piece: bytes) -> list[bytes]:
        """The tokens of the best segmentation of one piece, of equals that with fewer tokens."""
        best, count, back = [0], [0], [0]
        for end in range(len(piece)):
            node, choice = self.edges[0], None
            for begin in range(end, -1, -1):
                to = node.get(piece[begin])
                if to is None:
                    break
                if self.cost[to] >= 0:
                    offer = (best[begin] + self.cost[to], count[begin] + 1, begin)
                    choice = offer if choice is None or offer[:2] < choice[:2] else choice
                node = self.edges[to]
            if choice is None:
                raise ValueError("the vocabulary lacks a single byte")
            for column, value in zip((best, count, back), choice):
                column.append(value)
        out, end = [], len(piece)
        while end:
            out.append(piece[back[end] : end])
            end = back[end]
        return out[::-1]

    def learn(self, words: Iterable[str]) -> dict[str, int]:
        """The counts of words; a word is a stretch of text whose ends no piece crosses."""
        findall = self.cut.findall
        plain = _PLAIN.fullmatch if self.at_spaces else lambda word: None
        alone: dict[str, bytes] = {}  # words of one piece
        others: list[tuple[str, list[bytes]]] = []
        for word in words:
            if plain(word):
                alone[word] = word.encode()
                continue
            pieces = findall(word)
            if len(pieces) == 1:
                alone[word] = word.encode("utf-8", "replace")
            else:
                others.append((word, [p.encode("utf-8", "replace") for p in pieces]))
        counts = self.terminal_counts({*alone.values(), *(p for _, pieces in others for p in pieces)})
        out = {word: counts[piece][1] for word, piece in alone.items()}
        out.update((word, sum([counts[p][1] for p in pieces])) for word, pieces in others)
        return out

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.at_spaces or _UNSAFE.search(text):
            return self.cut.findall(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of texts; the words that are not stored yet are learnt together."""
        split = [self.split(t) for t in texts]
        known, older = self.words, self.older
        missing = set().union(*split).difference(known)
        met = {w: older[w] for w in missing if w in older}
        met |= self.learn(missing.difference(met))
        if len(known) + len(met) > CACHE_WORDS // 2:
            get = (known | met).__getitem__
            self.older, self.words = (known, met) if len(met) <= CACHE_WORDS // 2 else ({}, {})
        else:
            known |= met
            get = known.__getitem__
        return [sum(map(get, words)) for words in split]


_counters: dict[str, TrieCounter] = {}
keeps_cache("token_counts", _counters.clear)


def _counter(key: str, tokens: list[bytes], costs: list[int]) -> TrieCounter:
    """One counter a Python worker and model, whatever the number of its tasks."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = TrieCounter(tokens, costs)
    return _counters[key]


def token_counts(docs: DataFrame, path: str | None = None, text_col: str = "text", into: str = "n_tokens", costs: list[int] | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` (without its text, if not ``keep_text``) with the number of tokens of each text; a column of that name gives way.

    ``costs``: fixed-point costs of the tokens by rank; Zipf's where none are given.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tokens = load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    model = (tokens, costs or zipf_costs(len(tokens)))
    key, sent = hashlib.sha256(repr(model).encode()).hexdigest(), spark.sparkContext.broadcast(model)  # bounded by the vocabulary's size
    kept = [*(c for c in docs.columns if c not in (into, text_col)), text_col]  # last: the text only comes back where it is asked for
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    back = len(kept) if keep_text else len(kept) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory("token_counts")
        counter = _counter(key, *sent.value)
        for whole in batches:
            for begin, end in chunks(pc.fill_null(pc.binary_length(whole.column(len(kept) - 1)), 0).to_pylist()):
                batch = whole.slice(begin, end - begin)
                counts = counter.count([t or "" for t in batch.column(len(kept) - 1).to_pylist()])
                yield pa.record_batch([*batch.columns[:back], pa.array(counts, pa.int64())], [*kept[:back], into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields[:back], StructField(into, LongType())]))


def fitted_costs(docs: DataFrame, path: str | None = None, text_col: str = "text", costs: list[int] | None = None) -> list[int]:
    """Costs of the tokens by rank, by how often each stands in the best segmentations (under ``costs``) of all texts.

    Every count is one more than it is, so that no token is impossible. A task hands on a row for each token that it
    met; their sums, at most as many as the vocabulary has tokens, come to the driver.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tokens = load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    model = (tokens, costs or zipf_costs(len(tokens)))
    key, sent = hashlib.sha256(repr(model).encode()).hexdigest(), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, *sent.value)
        rank = {t: k for k, t in enumerate(sent.value[0])}
        met = np.zeros(len(rank), np.int64)
        for batch in batches:
            words = Counter(w for t in batch.column(0).to_pylist() if t for w in counter.split(t))
            pieces: Counter = Counter()
            for word, n in words.items():
                for piece in counter.cut.findall(word):
                    pieces[piece.encode("utf-8", "replace")] += n
            for piece, n in pieces.items():
                for token in counter.segment(piece):
                    met[rank[token]] += n
        some = np.flatnonzero(met)
        yield pa.record_batch([pa.array(some), pa.array(met[some])], ["token", "n"])

    counted = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = [1] * len(tokens)
    for row in counted.collect():
        counts[row["token"]] += row["n"]
    total = math.log(sum(counts))
    return [round(FIXED_POINT * (total - math.log(n))) for n in counts]


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return token_counts(docs, keep_text=False).select("doc_id", "n_bytes", "n_tokens")
