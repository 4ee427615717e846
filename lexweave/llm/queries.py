"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, divergence, html, jaccard, lexical, licenses, mixing, phrases, quality, sharding, suffixes, topk
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _on(table: str, digest: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: digest(read(spark, sf_dir, table))


def _encoding(docs: DataFrame) -> DataFrame:
    return bpe.encoding_digest(docs, tokenizer_path())


@functools.cache
def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": _on("documents", suffixes.suffix_digest),
        "op2_substring_dedup": _on("documents", phrases.passage_digest),
        "op3_exact_top_k": _on("embeddings", topk.top_k_digest),
        "op4_source_mixing": _on("documents", mixing.mixing_digest),
        "op5_sharding": _on("documents", sharding.sharding_digest),
        "op6_preference_formatting": _on("conversations", chat.preference_digest),
        "op7_html_extraction": _on("pages", html.extraction_digest),
        "op8_bpe": _on("documents", _encoding),
        "op9_quality_rules": _on("documents", quality.quality_digest),
        "op10_ngram_jaccard": _on("documents", jaccard.joined),
        "op11_source_divergence": _on("documents", divergence.source_divergence),
        "op12_license_scan": _on("documents", licenses.license_digest),
        "op13_lexical_search": lambda spark, sf_dir: lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_top_k": topk.ORACLE,
        "op4_source_mixing": mixing.ORACLE,
        "op6_preference_formatting": chat.ORACLE,
        "op9_quality_rules": quality.ORACLE,
        "op11_source_divergence": divergence.ORACLE,
        "op12_license_scan": licenses.ORACLE,
        "op13_lexical_search": lexical.ORACLE,
    }
