"""The queries of the numbered operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tunelake.llm import (
    best_fit_packing,
    byte_bpe,
    conversation_repair,
    crf_language_id,
    curriculum_mix,
    exact_dedup,
    hilbert_sharding,
    line_dedup,
    ngram_jaccard_join,
    parsing_fingerprint,
    phrase_mining,
    pitman_yor_lm,
    suffix_dedup,
)

MODULES = (ngram_jaccard_join, line_dedup, parsing_fingerprint, best_fit_packing, exact_dedup, crf_language_id, pitman_yor_lm, byte_bpe, suffix_dedup, hilbert_sharding, phrase_mining, curriculum_mix, conversation_repair)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in MODULES for name, fn in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
