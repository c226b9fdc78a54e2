"""Layouts on disk: tables sorted by a key into block folders, and per-query or baseline partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators.blocks import BLOCKS, order_by, with_block


def write_layout(df: DataFrame, path: str, sort_key: str, key: Sequence[str], blocks: int = BLOCKS) -> None:
    """All rows in folders block_id=1..B under a sort order; rows are sorted within files, so footers prune too."""
    placed = with_block(df, [sort_key, *(k for k in key if k != sort_key)], blocks)
    # a block may be large: its rows are dealt out by ranges, not sent to one task
    ranged = placed.repartitionByRange(F.col("block_id"), *order_by([sort_key, *key])).sortWithinPartitions("block_id", *order_by([sort_key]))
    ranged.write.mode("overwrite").partitionBy("block_id").parquet(path)


def read_partition(spark: SparkSession, path: str, blocks: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of some blocks with some columns: folders are pruned by block, files by column."""
    df = spark.read.parquet(path)
    if blocks is not None:
        df = df.where(F.col("block_id").isin([int(b) for b in blocks]))
    df = df.drop("block_id")
    return df.select(*[c for c in df.columns if columns is None or c in columns])


def partition_rows(df: DataFrame, order: Sequence[str], blocks: Sequence[int], n_blocks: int = BLOCKS) -> DataFrame:
    """The rows of the chosen blocks, by exact block number."""
    return with_block(df, order, n_blocks).where(F.col("block_id").isin([int(b) for b in blocks]))


def write_partition(df: DataFrame, path: str, order: Sequence[str], blocks: Sequence[int], columns: Sequence[str], n_blocks: int = BLOCKS) -> None:
    """A query's own partition: chosen blocks, chosen columns, in sort order."""
    rows = partition_rows(df, order, blocks, n_blocks)
    rows.repartitionByRange(*order_by(order)).sortWithinPartitions(*order_by(order)).select(*columns).write.mode("overwrite").parquet(path)


def write_vertical(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """All rows with the chosen columns."""
    df.select(*columns).write.mode("overwrite").parquet(path)


def _part(attributes: Sequence[str], parts: int, digest: bool) -> Column:
    """The partition of a row; by digest it is one that any engine with MD5 gives, else Spark's own hash."""
    if not digest:
        return F.pmod(F.hash(*attributes), F.lit(parts))
    text = F.concat_ws("\0", *[F.col(c).cast("string") for c in attributes])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")


def write_hashed(df: DataFrame, path: str, attributes: Sequence[str], parts: int = 3, digest: bool = False) -> None:
    """Rows in folders part=0..parts-1 by a hash of the attributes."""
    hash_partition_rows(df, attributes, parts, digest).write.mode("overwrite").partitionBy("part").parquet(path)


def write_bucketed(df: DataFrame, table: str, attributes: Sequence[str], parts: int = 3) -> None:
    """A bucketed table: joins and groupings on the attributes need no exchange."""
    df.write.mode("overwrite").bucketBy(parts, *attributes).sortBy(*attributes).saveAsTable(table)


def hash_partition_rows(df: DataFrame, attributes: Sequence[str], parts: int = 3, digest: bool = False) -> DataFrame:
    return df.withColumn("part", _part(attributes, parts, digest))


def release(spark: SparkSession, path: str) -> bool:
    """Deletes a partition's folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True))


def partition_name(table: str, query: str, method: str = "advisor") -> str:
    return f"{table}_{query}_{SUFFIX[method]}"


#: Name suffixes of the compared methods.
SUFFIX = {"advisor": "p", "drl_h": "p0", "heuristic_h": "p1", "heuristic_v": "p2"}
