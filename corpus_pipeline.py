"""From raw documents to a training mix: stages in order, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import decontaminate, mixing, neardup, passages, quality
from emberwatch.llm.common import shared_folder, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; trusted are those that `labels` has as good and not toxic."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 of 5-word shingles) stays: the one with the smallest id."""
    return neardup.deduplicated(docs, k=5, least=80, sketch=neardup.Sketch(bands=25, rows=4))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document's are cut out of the text; n_chars follows."""
    found = passages.without_repeats(docs)
    chars = F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    items = decontaminate.questions(table(spark, sf_dir, "benchmark"))
    return decontaminate.decontaminated(docs, decontaminate.indexes(items))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per epoch of its source; no source more than twice, none less than once."""
    return mixing.mix(docs, repeats=2.0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Sketches, rolling hashes and BM25 passages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read again."""
    shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
