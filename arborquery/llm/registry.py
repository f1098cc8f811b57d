"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, html_text, language_model, matroska, ngram_join, pii, toxicity, unigram, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_html_text": html_text.op3_html_text,
        "op4_language_model": language_model.op4_language_model,
        "op5_warc": warc.op5_warc,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_media": matroska.op7_media,
        "op8_token_counts": unigram.op8_token_counts,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_bpe": bpe.op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.SQL}
