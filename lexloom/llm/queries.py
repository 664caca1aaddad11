"""Registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, media, mixing, ngram_join, quality_classifier, quality_rules, substring_dedup, token_counts, toxicity
from .sql import QUALITY_ABLATIONS_SQL, QUALITY_RULES_SQL
from .storage import table

#: Vocabularies, by name in the installed tokenizer package.
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_PIECES = "word_bpe_49k.json"

#: Target weights of the mix: the large source counts as much as two small ones.
SOURCE_WEIGHTS = {"src0": 4} | {f"src{i}": 2 for i in range(1, 10)} | {f"src{i}": 1 for i in range(10, 20)}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, word-piece tokens and unknown words."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_PIECES))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and prediction."""
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and digests of its ids and of the text decoded from them."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements, base verdict and verdict of policy v1, from the stored ledger."""
    led = quality_rules.stored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.policy_mask("base"))) != 0
    return quality_rules.apply_policy(led, "v1").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed"
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v2 does, over all documents, from the stored ledger."""
    return quality_rules.ablations(quality_rules.stored(table(spark, sf_dir, "documents").select("doc_id", "text")), "v2")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image in an archive, read back by the data source and described."""
    return media.describe(media.read_archives(media.write_archives(table(spark, sf_dir, "documents"))))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block and place in the mix of sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs, SOURCE_WEIGHTS)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its 4-word shingle set and its link component (Jaccard >= 0.85)."""
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, words removed as recurring 35-word passages, and a digest of the rest."""
    return substring_dedup.summary(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by two co-trained views."""
    return quality_classifier.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_counts, op2_toxicity, op3_byte_bpe, op4_html_extraction, op5_quality_rules, quality_ablations,
            op6_media_columns, op7_source_mixing, op8_ngram_jaccard_join, op9_substring_dedup, op10_quality_classifier,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": QUALITY_RULES_SQL, "quality_ablations": QUALITY_ABLATIONS_SQL}
