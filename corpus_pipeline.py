"""A training-corpus pipeline: each stage takes the documents that the stage before it kept.

Stages are applied to ``documents(doc_id, text, lang, source, n_chars)``; all but the last return these columns
(and any others that came in). Between stages the rows are written to the shared folder and read again, so a lost
executor costs one stage at most and no stage plans over the lineage of another.

Empty inputs give empty outputs; null texts have no words and leave with the quality rules. The near-copy stage
keeps the smallest doc_id of each class; rows without a doc_id cannot be told apart by it and stay. A document
that loses words keeps the rest joined by single spaces; one that loses none keeps its text as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.bpe import encode_documents
from lattica.llm.common import materialize, read, release, scratch_mark
from lattica.llm.mixing import mix
from lattica.llm.quality import quality_filter
from lattica.llm.repeats import remove_repeats
from lattica.llm.simhash_wide import similar_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_filter(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest, of each class of near copies: 5-word shingles, similarity 0.8 or more."""
    classes = similar_dedup(docs.select("doc_id", "text"))
    return docs.join(classes.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows that a smaller document has."""
    out = remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix(docs).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of the decoded bytes."""
    return encode_documents(docs.drop("n_chars"), keep_text=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("encode_tokens", encode_tokens),
]

#: The classes of near copies, the windows' hashes and the tokenizer's merges are beyond SQL; the tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    begin = scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(begin, scratch_mark() - 1)  # all that the stage wrote on its way, and what it read
    return STAGES[-1][1](spark, docs, sf_dir)
