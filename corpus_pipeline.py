"""The corpus pipeline: each stage is one operator applied to what the stage before kept.

Quality rules drop rejected documents; SimHash near-duplicates keep one document of
each group; contaminated documents go; secrets are masked inside their texts;
what remains is packed into sequences. A row without a doc_id cannot be named as
another's copy and stays in the second stage; the others treat it as any row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mutua.llm import decontaminate, packing, quality, secrets, similar_texts
from mutua.storage import materialise, table

#: Near duplicates: SimHash deletion variants propose, the similarity of five-word shingles decides.
NEAR_SIMILARITY = 0.8

ORACLE_SQL = None  # trained trees and a greedy packing have no SQL form; tests use brute force


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar_texts.keep_one(docs, NEAR_SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.word_count())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
