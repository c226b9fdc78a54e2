"""Work folders: written and re-read frames where a plan has to be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def work_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share; a temporary one only where it is unset and all work is
    local."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="stratum-")
    return _own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/stratum/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
