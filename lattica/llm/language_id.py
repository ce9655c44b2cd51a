"""Language identification by Bayesian evidence fusion (operator 10).

The posterior of a page's language multiplies four pieces of evidence: how likely its main text is under each
language (hashed byte trigrams), how likely such a page declares the language that its markup declares, how likely
it has its address suffix, and a prior of its host. The last three are counted over the whole corpus by grouped
aggregation of the first-pass languages (those that the text alone suggests). Host priors are smoothed
hierarchically: a host leans on its parent domain, a parent domain on the corpus, each with the weight of
``KAPPA`` pages. A page's own vote is taken out of the counts that judge it.

Documents are identified as well: their source stands for the host, and they declare nothing.

The text model is fitted on the driver on a bounded sample of labelled documents: an equal part of ``SAMPLE_DOCS`` of
each language that any labelled row has, ``LEAST_DOCS`` of each at least (or all it has), those with the least hash of
their id. The languages are thus those of all labelled rows, however rare. All counts and priors cover all rows. Texts are scored whole; what a text says
saturates at ``TEXT_TRIGRAMS`` trigrams, as they are not independent.

Defined cases: null or empty texts leave the other evidence; null URLs, hosts without a dot and missing or unknown
declarations are no evidence; ties go to the first language in code-point order; repeated rows are judged each;
without labelled documents every language is null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import materialize, read
from lattica.llm.html_extract import Model, main_text, trained
from lattica.llm.url_filter import host_and_path

SAMPLE_DOCS, LEAST_DOCS, TEXT_TRIGRAMS, KAPPA, ALPHA = 600, 20, 200, 8.0, 1.0
SLOTS = 1 << 16

_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})", re.I)


def slots(data: np.ndarray) -> np.ndarray:
    """The slot of each byte trigram."""
    x = data.astype(np.uint32)
    h = x[:-2] * np.uint32(0x01000193) + x[1:-1] * np.uint32(0x9E3779B1) + x[2:] * np.uint32(0x85EBCA6B)
    return (h ^ (h >> np.uint32(15))) & np.uint32(SLOTS - 1)


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # SLOTS x languages, log likelihoods

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (texts x languages), cut to the weight of ``TEXT_TRIGRAMS``; numbers of trigrams."""
        raw = [t.lower().encode("utf-8", "replace") for t in texts]
        size = np.array([max(len(r) - 2, 0) for r in raw], np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        for k in np.flatnonzero(size):
            data = np.frombuffer(raw[k], np.uint8)
            for at in range(0, len(data) - 2, 1 << 20):  # bounded memory for very long texts
                out[k] += self.table[slots(data[at : at + (1 << 20) + 2])].sum(0, dtype=np.float64)
        weight = np.minimum(size, TEXT_TRIGRAMS) / np.maximum(size, 1)
        return out * weight[:, None], size


def fit_text_model(rows: list[tuple[str, str]]) -> TextModel:
    """From ``(language, text)`` pairs."""
    languages = sorted({lang for lang, _ in rows})
    counts = np.full((SLOTS, max(len(languages), 1)), 0.1)
    for lang, text in rows:
        data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
        if len(data) > 2:
            counts[:, languages.index(lang)] += np.bincount(slots(data), minlength=SLOTS)
    return TextModel(languages, np.log(counts / counts.sum(0)).astype(np.float32))


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """``(language, text)`` of the least hashes of each language; every language of a labelled row is in it."""
    labelled = docs.where("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL").withColumn("h", F.xxhash64("doc_id"))
    found = labelled.select("lang").distinct().count()
    if not found:
        return []
    each = max(LEAST_DOCS, -(-rows // found))

    def least(df: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
        return df.withColumn("rank", rank).where(F.col("rank") <= each)

    edges = least(labelled.select("lang", "h", "doc_id")).groupBy("lang").agg(F.max("h").alias("edge"))
    chosen = least(labelled.select("lang", "h", "doc_id", "text").join(F.broadcast(edges), "lang").where("h <= edge"))
    return [(r.lang, r.text) for r in chosen.orderBy("h", "doc_id").select("lang", "text").toLocalIterator()]


_ITEM = "kind string, id long, host string, parent string, declared string, suffix string, score array<double>, own int"


def _address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, parent domain (its last two labels) and suffix (its last label) of a URL."""
    host = host_and_path(url)[0].rpartition("@")[2].partition(":")[0]
    labels = [x for x in host.split(".") if x]
    if len(labels) < 2:
        return (host or None), None, None
    return host, ".".join(labels[-2:]), labels[-1]


def _items(df: DataFrame, kind: str, text_model: TextModel, page_model: Model | None) -> DataFrame:
    """One row per document ``(doc_id, source, text)`` or page ``(page_id, url, html)``: its evidence."""
    sent = df.sparkSession.sparkContext.broadcast((text_model, page_model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_model, page_model = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                ids, where, texts = (c.to_pylist() for c in whole.slice(at, 512).columns)
                n = len(ids)
                if kind == "page":
                    declared = [(m[1].lower() if (m := _DECLARED.search(h or "")) else None) for h in texts]
                    address = [_address(u) for u in where]
                    texts = [main_text(h, page_model) for h in texts]
                else:
                    declared, address = [None] * n, [(s, None, None) for s in where]
                    texts = [t or "" for t in texts]
                scores, size = text_model.scores(texts)
                own = [int(s.argmax()) if k and len(s) else -1 for s, k in zip(scores, size)]
                yield pa.record_batch(
                    [
                        pa.array([kind] * n),
                        pa.array(ids, pa.int64()),
                        *(pa.array([a[k] for a in address], pa.string()) for k in (0, 1)),
                        pa.array(declared, pa.string()),
                        pa.array([a[2] for a in address], pa.string()),
                        pa.array(scores.tolist(), pa.list_(pa.float64())),
                        pa.array(own, pa.int32()),
                    ],
                    ["kind", "id", "host", "parent", "declared", "suffix", "score", "own"],
                )

    return df.mapInArrow(run, _ITEM)


def fuse(items: DataFrame, languages: list[str], kappa: float = KAPPA, alpha: float = ALPHA) -> DataFrame:
    """``items`` with ``language`` and ``probability``: priors and likelihoods by grouped aggregation, then the posterior."""
    n = len(languages)

    def votes() -> Column:
        return F.array(*(F.count_if(F.col("own") == k).cast("double") for k in range(n)))

    def table(key: str) -> DataFrame:
        return items.where(F.col(key).isNotNull()).groupBy("kind", key).agg(votes().alias(f"{key}_votes"))

    def total(df: DataFrame, column: str) -> list[float]:
        row = df.agg(*(F.coalesce(F.sum(F.col(column)[k]), F.lit(0.0)) for k in range(n))).first()
        return list(row)

    tables = {key: materialize(table(key), f"votes-{key}") for key in ("host", "parent", "declared", "suffix")}
    everywhere = list(items.agg(*(F.count_if(F.col("own") == k) for k in range(n))).first())
    world = [(c + 1.0) / (sum(everywhere) + n) for c in everywhere]
    out = items
    for key, votes_table in tables.items():
        out = out.join(votes_table, ["kind", key], "left")
    # all languages at once, over arrays: the row's own vote, the votes under each key without it, and what they say
    vote = F.array(*(F.when(F.col("own") == k, 1.0).otherwise(0.0) for k in range(n)))
    voted = F.when(F.col("own") >= 0, 1.0).otherwise(0.0)
    out = out.withColumn("_prior", F.array(*map(F.lit, world)))
    for key in ("parent", "host"):
        got = F.zip_with(f"{key}_votes", vote, lambda g, v: g - v)
        out = out.withColumn(f"_{key}", got).withColumn("_size", F.aggregate(f"{key}_votes", F.lit(0.0), lambda a, x: a + x) - voted)
        leaning = F.zip_with(f"_{key}", "_prior", lambda g, p: (g + kappa * p) / (F.col("_size") + kappa))
        out = out.withColumn("_prior", F.when(F.col(f"{key}_votes").isNull(), F.col("_prior")).otherwise(leaning))
    out = out.withColumn("fused", F.zip_with("score", "_prior", lambda s, p: s + F.log(p)))
    for key in ("declared", "suffix"):
        values = tables[key].select(key).distinct().count() + 1
        sums = F.array(*map(F.lit, total(tables[key], f"{key}_votes")))
        chance = F.zip_with(F.zip_with(f"{key}_votes", vote, lambda g, v: g - v + alpha), F.zip_with(sums, vote, lambda t, v: t - v + alpha * values), lambda g, t: F.log(g / t))
        out = out.withColumn("fused", F.when(F.col(f"{key}_votes").isNull(), F.col("fused")).otherwise(F.zip_with("fused", chance, lambda s, c: s + c)))
    out = out.withColumn("top", F.array_max("fused"))
    weight = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    language = F.element_at(F.array(*map(F.lit, languages)), F.array_position("fused", F.col("top")).cast("int"))
    return out.withColumns({"language": language, "probability": 1 / weight}).drop("_prior", "_size", "_parent", "_host")


def identify(documents: DataFrame, pages: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(doc_id, page_id, language, probability, text_language, declared)``: a row per document and per page."""
    model = fit_text_model(labelled_sample(documents, sample_docs))
    items = _items(documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")), "document", model, None)
    page_rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    items = items.union(_items(page_rows, "page", model, trained(pages.sparkSession)))
    if not model.languages:
        out = items.withColumns({"language": F.lit(None).cast("string"), "probability": F.lit(None).cast("double")})
        text = F.lit(None).cast("string")
    else:
        out = fuse(materialize(items, "evidence"), model.languages)
        text = F.when(F.col("own") >= 0, F.element_at(F.array(*map(F.lit, model.languages)), F.col("own") + 1))
    return out.select(
        F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
        F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
        "language",
        "probability",
        text.alias("text_language"),
        "declared",
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and page."""
    return identify(read(spark, sf_dir, "documents", "doc_id", "lang", "source", "text"), read(spark, sf_dir, "pages", "page_id", "url", "html"))
