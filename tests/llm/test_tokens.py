import hashlib
import math
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from lattica.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", "Hello  world \n\n x", "don't I'll we've", "é中🎉 \t\r\n", "a" * 5000, "the the the " * 500, "\x1c \x85 \xa0\u2028x", "  \n \n  end  "]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary()


@pytest.fixture(scope="module")
def reference(vocabulary):
    ranks = {t: k for k, t in enumerate(vocabulary.tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(vocabulary, reference):
    codec = bpe.Codec(vocabulary)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices(" \n\t'abcstREé中🎉0123!?\x00\x1c\xa0²", k=rng.randint(0, 60))) for _ in range(3000)]
    for text, packed in zip(texts, codec.encode_packed(texts)):
        ids = memoryview(packed).cast("I").tolist()
        assert ids == reference.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60), st.binary(max_size=20))
@settings(max_examples=150, deadline=None)
def test_edits_and_appends(data, a, b, new):
    vocabulary = test_edits_and_appends.vocabulary = getattr(test_edits_and_appends, "vocabulary", None) or bpe.load_vocabulary()
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    encoder = bpe.PrefixEncoder(vocabulary, data)
    encoder.replace(a, b, new)
    want = bpe.PrefixEncoder(vocabulary, data[:a] + new + data[b:])
    assert encoder.ids() == want.ids() and encoder.last == want.last
    encoder.append(data)
    assert encoder.ids() == bpe.PrefixEncoder(vocabulary, data[:a] + new + data[b:] + data).ids()


def test_an_edit_stops_early(vocabulary):
    data = b"the quick brown fox jumps over the lazy dog " * 200
    encoder = bpe.PrefixEncoder(vocabulary, data)
    assert encoder.replace(10, 12, b"zz") < 600


def test_documents(spark, reference):
    rows = [(k, t, "x") for k, t in enumerate([*TEXTS, None])] + [(0, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_documents(df).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = reference.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.token_ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_counts_equal_a_unigram_model(spark):
    tokens = bpe.load_ranks(PATH)
    costs = token_counts.zipf_costs(len(tokens))
    counter = token_counts.TrieCounter(tokens, costs)
    visible = lambda data: "".join(chr(0x100 + b) for b in data)
    model = Tokenizer(models.Unigram([(visible(t), -c / token_counts.FIXED_POINT) for t, c in zip(tokens, costs)], None, False))
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices(" abcdeth\né1!", k=rng.randint(0, 80))) for _ in range(300)]
    want = [sum(len(model.encode(visible(p.encode())).ids) for p in counter.cut.findall(t)) for t in texts]
    assert counter.count(texts) == want
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(-1, None, "x")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()}
    assert got == {-1: 0, **dict(enumerate(want))}
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_costs_fitted_to_a_corpus(spark):
    tokens = bpe.load_ranks(PATH)
    counter = token_counts.TrieCounter(tokens, token_counts.zipf_costs(len(tokens)))
    texts = [*TEXTS[1:4], "alpha beta alpha gamma " * 30, "delta"]
    pieces = [p.encode() for t in texts for p in counter.cut.findall(t)]
    counts = counter.terminal_counts(pieces)
    for piece in set(pieces):
        own = counter.segment(piece)
        assert b"".join(own) == piece and len(own) == counts[piece][1]
    met = [1] * len(tokens)
    rank = {t: k for k, t in enumerate(tokens)}
    for piece in pieces:
        for token in counter.segment(piece):
            met[rank[token]] += 1
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string").repartition(3)
    fitted = token_counts.fitted_costs(df)
    assert fitted == [round(token_counts.FIXED_POINT * (math.log(sum(met)) - math.log(n))) for n in met]
    again = token_counts.TrieCounter(tokens, fitted)
    want = {k: again.count([t])[0] for k, t in enumerate(texts)} | {-1: 0}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, costs=fitted).collect()} == want
    with pytest.raises(ValueError, match="single byte"):
        token_counts.TrieCounter([b"a"], [1]).terminal_counts([b"ab"])
