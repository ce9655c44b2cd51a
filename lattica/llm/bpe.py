"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 6).

Greedy rank-ordered merging has a property that makes it a dynamic program over prefixes: every byte prefix of
a piece has exactly one valid last token, namely the one whose preceding prefix ends in a token that it can
stand beside without a merge across their border. ``PrefixEncoder`` stores that token for each prefix, so

* appending bytes continues the table and never revisits a stored entry (exact appends),
* an edit keeps the table up to the edit, and after it stops as soon as the stored tail is valid again,
* the encoding is read off backwards from the last entry.

Two tokens can stand side by side exactly if undoing their merges from the latest to the earliest never meets a
moment at which a merge across the border would have come first.

The text is cut by the tokenizer's pattern and each piece is encoded separately, as ordinary text, without
special tokens. Words repeat, so each Python worker keeps a bounded cache of encoded words; new ones are encoded in
sorted order, each from the table of the prefix that it shares with the one before.

Defined cases: a null or empty text encodes to no ids and decodes to the empty text; very long pieces take
time in proportion to their length; repeated rows give repeated rows; extra columns are ignored by the query.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lattica.llm.common import bounded_batches, keeps_cache, read, spare_memory

#: Most words whose encoding a worker keeps, in two halves of which the older goes first (some 80 MB).
CACHE_WORDS = 500_000
#: Most neighbour tests a worker remembers (some 20 MB).
CACHE_TESTS = 200_000
#: Texts are encoded together up to so many characters.
CHUNK_CHARS = 1 << 20


@dataclass
class Vocabulary:
    """Tokens by id, and for each token of two or more bytes the two tokens of its last merge."""

    tokens: list[bytes]
    halves: dict[int, tuple[int, int]]
    ids: dict[bytes, int] = field(init=False)
    merged: dict[tuple[int, int], int] = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.merged = {pair: i for i, pair in self.halves.items()}
        self.lengths = [len(t) for t in self.tokens]
        self.longest = max(self.lengths)
        self.tests: dict[int, bool] = {}
        self.endings: dict[int, list] = {}  # trie of the reversed tokens: byte to [what goes on, token that ends here or -1]
        for i, token in enumerate(self.tokens):
            node, at = self.endings, None
            for byte in reversed(token):
                at = node.get(byte)
                if at is None:
                    at = node[byte] = [{}, -1]
                node = at[0]
            if at is not None:
                at[1] = i

    def beside(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` unmerged when they are neighbours."""
        merged, halves = self.merged, self.halves
        before = len(self.tokens) + 1
        while True:
            across = merged.get((left, right))
            if across is not None and across < before:
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]  # an equal merge inside the left token lies further left: it goes first
            else:
                before, right = right + 1, b[0]  # and one inside the right token lies further right


def read_ranks(lines: Iterable[bytes]) -> list[bytes]:
    """Tokens in the order of their ranks, from lines of base64 token and rank."""
    pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file."""
    with open(path, "rb") as lines:
        return read_ranks(lines)


def build_halves(tokens: list[bytes]) -> dict[int, tuple[int, int]]:
    """The last merge of each token, in rank order: the split whose halves stand beside each other before it."""
    vocabulary = Vocabulary(tokens, {})
    halves, ids, merged = vocabulary.halves, vocabulary.ids, vocabulary.merged
    for i, token in enumerate(tokens):
        if len(token) < 2:
            continue
        for cut in range(1, len(token)):
            left, right = ids.get(token[:cut], i), ids.get(token[cut:], i)
            if left < i and right < i and (left, right) not in merged and vocabulary.beside(left, right):
                halves[i] = (left, right)
                merged[left, right] = i
                break
    return halves


def load_vocabulary(path: str | None = None) -> Vocabulary:
    tokens = load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return Vocabulary(tokens, build_halves(tokens))


class PrefixEncoder:
    """The table of last tokens of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        if data:
            self.append(data)

    def _entry(self, end: int) -> int:
        """The only valid last token of the prefix of ``end`` bytes, from the entries before it."""
        self._fill(end, end)
        return self.last.pop()

    def _fill(self, first: int, end: int) -> None:
        """Store the entries of the prefixes of ``first`` to ``end`` bytes."""
        v, data, last = self.vocabulary, self.data, self.last
        root, tests, width = v.endings, v.tests, len(v.tokens)
        get, put = tests.get, last.append
        for stop in range(first - 1, end):
            node, begin = root, stop
            while True:
                at = node.get(data[begin])
                if at is None:
                    raise ValueError("the vocabulary lacks a single byte")
                node, token = at
                if token >= 0:
                    if not begin:
                        break
                    before = last[begin - 1]
                    fits = get(before * width + token)
                    if fits is None:
                        if len(tests) >= CACHE_TESTS:
                            tests.clear()
                        fits = tests[before * width + token] = v.beside(before, token)
                    if fits:
                        break
                begin -= 1
            put(token)

    def append(self, data: bytes) -> None:
        begin = len(self.data)
        self.data += data
        self._fill(begin + 1, len(self.data))

    def change_to(self, data: bytes) -> None:
        """Encode ``data`` instead, keeping the entries of the prefix that both share."""
        before = self.data
        shared, most = 0, min(len(data), len(before))
        while shared < most and before[shared] == data[shared]:
            shared += 1
        del self.last[shared:]
        self.data = bytearray(data)
        self._fill(shared + 1, len(data))

    def packed(self, data: bytes) -> bytes:
        """``change_to`` and ``ids`` in one, as little-endian unsigned 32-bit numbers; for many pieces in sorted order."""
        before, last, lengths = self.data, self.last, self.vocabulary.lengths
        shared = 0
        for a, b in zip(before, data):
            if a != b:
                break
            shared += 1
        del last[shared:]
        self.data = data
        self._fill(shared + 1, len(data))
        out, at = array("I"), len(data)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out.tobytes()

    def replace(self, begin: int, end: int, data: bytes) -> int:
        """Put ``data`` in the place of bytes ``begin`` to ``end``; returns how many entries were computed.

        An entry depends on the bytes of the longest token before it and on earlier entries within that reach.
        Behind the edit, once as many entries in a row as the longest token equal the stored ones, so do all.
        """
        tail = self.last[end:]
        self.data = bytearray(self.data)
        self.data[begin:end] = data
        del self.last[begin:]
        start, computed, same = begin + len(data), 0, 0
        for at in range(begin, len(self.data)):
            if at >= start and same >= self.vocabulary.longest:
                self.last += tail[at - start :]
                break
            self.last.append(self._entry(at + 1))
            computed += 1
            if at >= start:
                same = same + 1 if self.last[-1] == tail[at - start] else 0
        return computed

    def ids(self) -> list[int]:
        out, at, last, lengths = [], len(self.data), self.last, self.vocabulary.lengths
        while at:
            token = last[at - 1]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out


#: The tokenizer's pattern never lets a piece run over the start of a space, but where white space comes before
#: that space and none but white space (or nothing) after it. Without such a place a text may be cut at its spaces.
_PLAIN = re.compile(r" ?[a-zA-Z]+")  # is one piece
_UNSAFE = re.compile(r"\s (?!\S)")


class Codec:
    """Encodes and decodes whole texts."""

    cache_words = CACHE_WORDS

    def __init__(self, vocabulary: Vocabulary, pattern: str = public_tokenizers.PATTERN) -> None:
        self.vocabulary = vocabulary
        self.cut = regex.compile(pattern)
        self.at_spaces = pattern == public_tokenizers.PATTERN
        self.words: dict[str, bytes] = {}  # a stretch of text whose ends no piece crosses, to its packed ids
        self.older: dict[str, bytes] = {}  # the half of them that was filled before

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.at_spaces or _UNSAFE.search(text):
            return self.cut.findall(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """The packed ids of words. Pieces are encoded in sorted order and keep the table of a shared prefix."""
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
        packed: dict[bytes, bytes] = {}
        whole, encoder = self.vocabulary.ids, PrefixEncoder(self.vocabulary)
        for piece in sorted({*alone.values(), *(p for _, pieces in others for p in pieces)}):
            token = whole.get(piece)
            packed[piece] = encoder.packed(piece) if token is None else token.to_bytes(4, "little")
        out = {word: packed[piece] for word, piece in alone.items()}
        out.update((word, b"".join([packed[p] for p in pieces])) for word, pieces in others)
        return out

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = [self.split(t) for t in texts]
        known, older = self.words, self.older
        missing = set().union(*split).difference(known)
        met = {w: older[w] for w in missing if w in older}
        met |= self.learn(missing.difference(met))
        if len(known) + len(met) > self.cache_words // 2:
            get = (known | met).__getitem__
            self.older, self.words = (known, met) if len(met) <= self.cache_words // 2 else ({}, {})
        else:
            known |= met
            get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed([text])[0]).cast("I").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def chunks(sizes: Iterable[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together stay below ``most``, or hold one row."""
    begin, held, at = 0, 0, -1
    for at, size in enumerate(sizes):
        if at > begin and held + size > most:
            yield begin, at
            begin, held = at, 0
        held += size
    if at >= begin:
        yield begin, at + 1


_codecs: dict[tuple, Codec] = {}
keeps_cache("bpe", _codecs.clear)


def _codec(key: str, ranks: bytes, pairs: bytes, pattern: str) -> Codec:
    """One codec a Python worker, vocabulary and pattern, whatever the number of its tasks."""
    if (key, pattern) not in _codecs:
        _codecs.clear()
        tokens = read_ranks(ranks.splitlines())
        flat = np.frombuffer(pairs, np.int32).reshape(-1, 3).tolist()
        _codecs[key, pattern] = Codec(Vocabulary(tokens, {i: (a, b) for i, a, b in flat}), pattern)
    return _codecs[key, pattern]


def encode_documents(
    docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", ids: bool = True, keep_text: bool = True
) -> DataFrame:
    """``docs`` (without its text, if not ``keep_text``) with ``n_tokens``, ``token_ids`` (array of int, if ``ids``),
    ``ids_sha256`` and ``decoded_sha256``.

    The text is decoded from its ids, not copied. Columns of ``docs`` with these names give way. The rank file is
    read on the driver; what executors get is its bytes and merges, bounded by the vocabulary's size.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = file.read()
    halves = build_halves(read_ranks(ranks.splitlines()))
    pairs = np.array([(i, *ab) for i, ab in halves.items()], np.int32).tobytes()
    key, sent = hashlib.sha256(ranks).hexdigest(), spark.sparkContext.broadcast((ranks, pairs))
    names = ["n_tokens", *["token_ids"] * ids, "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c not in names and c != text_col]
    kept += [text_col]  # last: the text only comes back where it is asked for
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    back = len(kept) if keep_text else len(kept) - 1
    kinds = [LongType(), *[ArrayType(IntegerType())] * ids, StringType(), StringType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory("bpe")
        codec = _codec(key, *sent.value, pattern)
        for whole in batches:
            texts = whole.column(len(kept) - 1)
            for begin, end in chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                batch = whole.slice(begin, end - begin)
                counts, arrays, first, second = [], [], [], []
                for packed in codec.encode_packed([t or "" for t in batch.column(len(kept) - 1).to_pylist()]):
                    numbers = memoryview(packed).cast("I")
                    counts.append(len(numbers))
                    if ids:
                        arrays.append(pa.array(numbers, pa.int32()))
                    first.append(hashlib.sha256(packed).hexdigest())
                    second.append(hashlib.sha256(codec.decode(numbers.tolist())).hexdigest())
                made = [pa.array(counts, pa.int64())]
                if ids:
                    offsets = pa.array([0, *accumulate(counts)], pa.int32())
                    made.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(arrays)))
                made += [pa.array(first, pa.string()), pa.array(second, pa.string())]
                yield pa.record_batch([*batch.columns[:back], *made], [*kept[:back], *names])

    schema = StructType([*docs.schema.fields[:back], *(StructField(n, k) for n, k in zip(names, kinds))])
    return docs.mapInArrow(run, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoding and decoding of every document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return encode_documents(docs, ids=False, keep_text=False)
