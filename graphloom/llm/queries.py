"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import decontam, html_text, lm_score, pieces, pii, quality_forest, simhash, suffix_dedup, token_counts, toxicity


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(C.table(spark, sf_dir, "documents"), ["doc_id"])


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(C.table(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(C.table(spark, sf_dir, "documents"), [])
    return token_counts.suffix_sums(token_counts.histogram(lengths))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"), ["doc_id"])


def op7_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_forest.judged(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"), ["doc_id"])


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(C.table(spark, sf_dir, "documents"), ["doc_id"])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(C.table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(C.table(spark, sf_dir, "documents"), ["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_html_text": op2_html_text,
        "op3_decontamination": op3_decontamination,
        "op4_token_counts": op4_token_counts,
        "op5_toxicity": op5_toxicity,
        "op6_lm_score": op6_lm_score,
        "op7_quality_forest": op7_quality_forest,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_simhash": op9_simhash,
        "op10_suffix_dedup": op10_suffix_dedup,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {}
