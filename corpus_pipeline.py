"""A corpus pipeline of five stages over ``documents``: what it rejects goes, copies go, repeated passages go, personal data is masked, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, packing, personal_data, quality, substring_dedup
from lodestone.llm.common import drop, save, tidy

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEPT = ("text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts (score 0.5 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_documents(docs, labels, carry=KEPT).where("accepted").select(COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links (five words, 0.8): the one with the least doc_id."""
    return jaccard_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows of 35 that stand elsewhere too.

    A text that loses nothing keeps its white space. One that loses words has the others joined by one
    space; one that loses all its words is dropped, as nothing of it is left.
    """
    done = substring_dedup.dedup_substrings(docs, carry=KEPT)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept").cast("string"))
    left = done.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return personal_data.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("substring dedup", substring_stage),
    ("PII", personal_data_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained classifier; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next, and what only it needed is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with tidy(kept):
            docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
