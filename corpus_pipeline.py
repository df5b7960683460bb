"""The corpus pipeline: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import decontamination, minhash_dedup, mixing, pii, quality_classifier
from fathomline.llm._common import saved, table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, trained on the labelled ones among docs, scores 0.5 or more."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    (score,) = unused(docs.columns, "score")
    return quality_classifier.scored(docs, model, score_col=score).where(F.col(score) >= 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest doc_id."""
    return minhash_dedup.deduplicated(docs, shingle_words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), shingle_words=5, similarity=0.8)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal values replaced by pseudonyms; n_chars is that of the new text."""
    (count,) = unused(docs.columns, "n_pii")
    return pii.pseudonymised(docs, pii.session_key(spark), count_col=count).withColumn("n_chars", F.length("text").cast("long")).drop(count)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows at least once: the smallest budget that covers each source, rarer sources repeated towards the target entropy."""
    return mixing.mixed(docs, mixing.Target(entropy=0.95, repeats=4.0, cover=True))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pseudonymise), ("mix", mix)]

#: Hashed models and sketches have no DuckDB counterpart; tests/llm/test_pipeline.py has brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
