"""Corpus pipeline: documents through quality rules, near-dedup, suffix dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents: the first drops rejected documents and removes
over-frequent lines, the second keeps the first document of each class, the third cuts repeated strings out of the
texts, the fourth drops documents that hold benchmark items; the last returns a row per packed piece.

Defined cases, at every stage: a null text is an empty one, so the first stage rejects it (it has fewer words than
MIN_WORDS); a null source is a host of its own; a null doc_id is an id like any other, before all others; rows that
share an id but not the text are documents of their own, and of rows equal in id and text the second stage keeps one;
among equal documents the one with the least id stays. Texts of any length are taken whole, and a text that loses bytes
keeps its row, even with an empty rest. Extra columns, whatever their names, stay as they are up to the fourth stage.
A table without rows, or without benchmark items, passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratum.llm import decontaminate, neardup, packing, quality, suffix
from stratum.llm.common import materialize, modest_batches, table, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return neardup.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return suffix.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return packing.digest(packing.pack(docs, vocabulary("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("suffix dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Tokenising and closing links to classes are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
