"""One query per operator over the given tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, classify, decontaminate, language, maxent, mixing, neardup, neighbours, passages, quality, spelling, tokens,
    whitening,
)
from .common import held_out, shared_folder, staged, table

#: A public sentencepiece model whose pieces serve as the vocabulary.
VOCABULARY = os.environ.get("PIECE_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    weights = quality.gram_weights(quality.with_trust(docs, table(spark, sf_dir, "labels"))).checkpoint()
    return quality.quality_rules(docs, weights)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10, 0))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), k=5, least=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.sentencepiece_pieces(VOCABULARY))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_chunks", "removed_words", "spans")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontaminate.indexes(decontaminate.questions(table(spark, sf_dir, "benchmark")))
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), made)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 5, 0)
    models = language.trained(docs.where(~out))
    return language.identified(docs.select("doc_id", "text"), models).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    features = staged(classify.with_statistics(table(spark, sf_dir, "documents")), "features")
    out = held_out(F.col("doc_id"), 3, 1)
    labels = table(spark, sf_dir, "labels").where(~out).select("doc_id", F.col("quality").alias("label"))
    model = classify.trained(features, labels)
    return classify.scored(features, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, repeats=2.0).drop("text")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(chat.turns_as_calls(table(spark, sf_dir, "conversations")), chat.REPLY_SCHEMAS)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whitened(rows, whitening.fitted(rows, most=32))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, F.col("vec_id") % 20 == 0, k=20)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variants(words)


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_language_id": op7_language_id,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_source_mixing": op9_source_mixing,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_nearest_neighbours": op12_nearest_neighbours,
        "op13_spelling_variants": op13_spelling_variants,
    }
