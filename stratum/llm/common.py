"""Shared plumbing of the training-data operators: work folders, materialisation, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size up to which a materialised side may be broadcast; larger sides are shuffled.
BROADCAST_BYTES = 16 << 20

_own_dir: str | None = None


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where that is unset and all work is local."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        # a path without a scheme is the cluster's default file system, for Python readers and writers too
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="stratum-")
    return _own_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/stratum/{name}-{uuid.uuid4().hex[:12]}"


def clear_work(spark: SparkSession) -> None:
    """Deletes everything that operators have written below the shared folder; for use when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/stratum")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of Spark's own batches while an intermediate frame is written, and in modest_batches.
_BATCH_ROWS = 512


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for the job inside; the session's own setting is back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), _BATCH_ROWS) if int(before) > 0 else _BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def modest_batches(spark: SparkSession) -> None:
    """For programs that own their session, as the registered queries do: smaller Arrow batches, unless the session has
    chosen its own. Operators never touch the setting of a caller's session for good."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(_BATCH_ROWS))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Deletes the files behind a materialised frame that nothing reads any more."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint behind a checked size: rows were counted on the materialised frame."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: Caches that outlive a task, by the operator whose tasks use them.
_caches: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Announces a cache of a Python worker; it is cleared as soon as the worker gets another operator's task."""
    _caches[owner] = clear


def _trim() -> None:
    """Gives freed memory back to the system, where Arrow's pool and the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


#: Bytes of a batch that a function gets at once; Spark's own batches hold up to 64 MiB.
BATCH_BYTES = 8 << 20


def parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most `rows` rows and about BATCH_BYTES (one row at least)."""
    n = batch.num_rows
    step = max(1, min(rows, n * BATCH_BYTES // max(1, batch.nbytes)))
    for at in range(0, n, step):
        some = batch.slice(at, step)
        # rows of very different sizes: cut again where a run came out too large
        if some.num_rows > 1 and some.nbytes > 2 * BATCH_BYTES:
            yield from parts(some, max(1, some.num_rows // 2))
        else:
            yield some


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory that went with earlier ones is given back now and then, as tasks may be long."""
    for i, batch in enumerate(batches, 1):
        yield batch
        if i % 32 == 0:
            _trim()


def arrow_map(df: DataFrame, fn, schema, rows: int = 512, owner: str = "") -> DataFrame:
    """mapInArrow over runs of rows small enough that long texts fit beside each other, whatever the session's batches.

    Workers live on between tasks, so caches of other operators than the owner are dropped first.
    """

    def run(batches):
        stale = [clear for name, clear in _caches.items() if name != owner]
        for clear in stale:
            clear()
        try:
            yield from fn(_trimmed(part for batch in batches for part in parts(batch, rows)))
        finally:
            _trim()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def strings(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty texts."""
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.large_string()), "")


def local_fs(uri: str):
    """pyarrow filesystem and path of a shared folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def dealt(total_bytes: int, block: int = 32 << 20) -> int:
    """Tasks for reading so many bytes back; given outright, as rows that only point at bytes look small to the planner."""
    return max(1, -(-int(total_bytes or 0) // block))
