"""Catalog of a folder of Parquet tables: sizes, cardinalities and columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.plans.views import TABLES, table

MB = 1024.0 * 1024.0


@dataclass(frozen=True)
class TableInfo:
    """A catalogued table; size in MB of its files."""

    name: str
    size_mb: float
    rows: int
    columns: tuple[str, ...]


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all data files below a folder, by Hadoop's file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength())


def relation_size(spark: SparkSession, path: str) -> float:
    return file_bytes(spark, path) / MB


def counts(spark: SparkSession, sf_dir: str, names=TABLES) -> DataFrame:
    """(table_name, n): exact cardinalities; counts of Parquet need no column."""
    parts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in names]
    return reduce(DataFrame.unionByName, parts)


def columns(spark: SparkSession, sf_dir: str, names=TABLES) -> DataFrame:
    """(table_name, position, column_name) in file order."""
    rows = [(t, i, c) for t in names for i, c in enumerate(table(spark, sf_dir, t).columns)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string")


def catalog(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, TableInfo]:
    n = {r.table_name: r.n for r in counts(spark, sf_dir, names).collect()}  # one row per table
    return {t: TableInfo(t, relation_size(spark, f"{sf_dir}/{t}.parquet"), n[t], tuple(table(spark, sf_dir, t).columns)) for t in names}


def catalog_frame(spark: SparkSession, sf_dir: str, names=TABLES) -> DataFrame:
    rows = [(c.name, c.size_mb, c.rows, len(c.columns), list(c.columns)) for c in catalog(spark, sf_dir, names).values()]
    return spark.createDataFrame(rows, "table_name string, size_mb double, tuple_num bigint, column_num int, columns array<string>")
