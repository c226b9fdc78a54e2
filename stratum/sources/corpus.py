"""Readers and writers around the tables: folders of SQL texts, delimited loads, CSV sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def sql_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, sql) of the .sql files in a folder: name without suffix, white space collapsed, last semicolon gone."""
    texts = spark.read.text(f"{folder}/*.sql", wholetext=True).select("value", F.input_file_name().alias("path"))
    one_line = F.regexp_replace(F.trim(F.regexp_replace("value", r"\s+", " ")), r"\s*;$", "")
    return texts.select(F.regexp_extract("path", r"([^/]+)\.sql$", 1).alias("query_id"), one_line.alias("sql"))


def query_names(spark: SparkSession, folder: str) -> list[str]:
    return sorted(r.query_id for r in sql_corpus(spark, folder).select("query_id").collect())  # one per file


def load_delimited(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Pipe-separated rows; an empty field is null."""
    return spark.read.schema(schema).option("sep", "|").option("nullValue", "").csv(path)


def save_delimited(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "|").option("nullValue", "").option("emptyValue", '""').csv(path)


def save_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, so that nothing of the first row is lost when it is read."""
    df.write.mode("overwrite").option("header", True).csv(path)


def load_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
