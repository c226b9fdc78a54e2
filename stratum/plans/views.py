"""Temp views over a folder of Parquet tables, and SQL run on them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over the folder's tables; only those that its text names are registered."""
    register(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", text, re.I)])
    return spark.sql(text)
