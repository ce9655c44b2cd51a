import time
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions.dom import TEXT, parse_dom
from lattica.functions.similarity import header_similarity, indel_ratio_sql
from lattica.functions.text import chunks_of, title_date
from lattica.functions.vectors import temporal_decay


def test_chunks_golden():
    assert [len(c) for c in chunks_of("a" * 1750)] == [1000, 900, 50]
    assert chunks_of("  ") == [] and chunks_of(None) == [] and chunks_of(" x ") == ["x"]


@given(st.text(alphabet="ab \n", max_size=4000), st.integers(20, 200), st.integers(0, 19))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_everything_and_end(text, size, overlap):
    pieces = chunks_of(text, size, overlap)
    assert all(len(p) <= size for p in pieces)
    words, found = set(text.split()), " ".join(pieces)
    assert all(w in found or len(w) > size - overlap for w in words)


@pytest.mark.parametrize(
    "title,day",
    [("2024-03-15", "2024-03-15"), ("x 15/03/2024", "2024-03-15"), ("15-03-2024 y", "2024-03-15"), ("2024-02-30 15/03/2024", "2024-03-15"), ("none", None), (None, None)],
)
def test_title_date(spark, title, day):
    got = spark.createDataFrame([(title,)], "t string").select(F.date_format(title_date(F.col("t")), "yyyy-MM-dd")).first()[0]
    assert got == day


def test_ratio_and_header_similarity(spark):
    rows = [("ab", "ba", 50.0), ("acuedo", "acuerdo", 1200 / 13), ("", "", 100.0), ("", "a", 0.0), ("fecha", "fec.", 600 / 9)]
    df = spark.createDataFrame(rows, "a string, b string, want double").select("want", F.expr(indel_ratio_sql("a", "b")).alias("got"))
    assert all(abs(r.want - r.got) < 1e-9 for r in df.collect())
    df = spark.createDataFrame([(["a"], ["a", "zzz"])], "a array<string>, b array<string>")
    assert df.select(header_similarity("a", "b"), header_similarity("b", "a")).first()[:] == (1.0, 0.5)


def test_decay(spark):
    rows = [(datetime(2024, 1, 1), 0.5), (datetime(2025, 6, 1), 1.0), (datetime(2023, 1, 1), 0.25), (None, 1.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, want double")
    got = df.select("want", temporal_decay(F.col("t"), F.expr("TIMESTAMP_NTZ'2024-12-31 00:00:00'")).alias("got")).collect()
    assert all(abs(r.want - r.got) < 1e-9 for r in got)


def test_dom_mends_markup():
    dom = parse_dom("<ul><li>a<li>b</ul><p>c<p>d<script>if(a<b){}</script>")
    tags = [(dom.tag[p], d) for t, p, d in zip(dom.tag, dom.parent, dom.data) if t == TEXT]
    assert tags == [("li", "a"), ("li", "b"), ("p", "c"), ("p", "d"), ("script", "if(a<b){}")]


@given(st.text(alphabet="<>/ab =\"'!-p", max_size=200))
@settings(max_examples=300, deadline=None)
def test_dom_takes_anything(text):
    dom = parse_dom(text)
    assert all(p < n for n, p in enumerate(dom.parent))


@pytest.mark.parametrize("html", ["<div>" * 8000 + "</span>" * 8000, "<p><table><td>" + "<div>" * 8000, "<p><button>" + "<b>" * 8000 + "<div>x" * 8000, "<li><ul>" * 4000 + "</p>" * 9000])
def test_deep_and_hostile_markup_takes_time_in_proportion(html):
    began = time.perf_counter()
    assert len(parse_dom(html).tag) > 7999
    assert time.perf_counter() - began < 1  # a search of the stack for each tag takes 10 s
