"""Queries and SQL of the corpus operators and of the pipeline."""

from __future__ import annotations

import corpus_pipeline
from lattica.llm import bpe, centroids, chat, filter_audit, html_extract, language_id, lattice, mixing, quality, repeats, simhash, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_embedding_near_dedup": lattice.op4_embedding_near_dedup,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_byte_bpe": bpe.op6_byte_bpe,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_substring_dedup": repeats.op8_substring_dedup,
        "op9_html_extraction": html_extract.op9_html_extraction,
        "op10_language_id": language_id.op10_language_id,
        "op11_chat_formatting": chat.op11_chat_formatting,
        "op12_centroid_clusters": centroids.op12_centroid_clusters,
        "op13_filter_audit": filter_audit.op13_filter_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op2_quality_rules": quality.OP2_SQL,
        "op4_embedding_near_dedup": lattice.OP4_SQL,
        "op7_url_filter": url_filter.OP7_SQL,
        "op8_substring_dedup": repeats.OP8_SQL,
        "op9_html_extraction": html_extract.OP9_SQL,
        "op11_chat_formatting": chat.OP11_SQL,
        "op12_centroid_clusters": centroids.OP12_SQL,
        "op13_filter_audit": filter_audit.OP13_SQL,
    }
