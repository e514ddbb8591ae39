"""A training corpus from `documents`, in five stages.

toxicity            documents with a score of 0.7 or more go
near_duplicates     of each group of near copies (SimHash at anchors and least hashes over five-word shingles, judged
                    by an exact Jaccard similarity of 0.8 or more) the document with the least doc_id stays
decontamination     documents that hold an item of `benchmark`, up to a few edits, go
personal_data       personal data is replaced by its kind in brackets
pieces              what is left is encoded and decoded; returned are doc_id, n_tokens and two digests

Each stage works on all that the one before kept, and leaves every row's columns as they are (personal_data
changes text and n_chars). Nulls in any column, empty and very long texts, ties, repeated rows, empty
tables and further columns are handled as the operators' docstrings say; a stage never drops a row for them
but for near copies and repeated rows, of which near_duplicates keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common, decontam, near_copies, pieces, pii, toxicity
from graphloom.scratch import Scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, ["doc_id"])


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("pieces", as_pieces),
]

#: SQL can't say these stages; tests hold each against a plain version in Python, one after another.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage kept is dropped once the next one's result is written, so that at most two
    copies of the corpus lie in the shared folder; the last one stays until scratch.clear() or the end of the session."""
    scratch, before = Scratch(spark), ""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
