"""Packing by power-of-two decomposition.

The ids of each document are cut into as many pieces of the full length as fit and one piece for each bit of what
is left, the longest first. Every piece is a sequence of its own, so no sequence crosses documents and none is
padded; pieces of equal length share a bucket, from which batches are drawn.

Defined cases: a null text is an empty one and holds the end id alone; repeated rows are documents of their own;
extra columns are ignored; an empty table gives no pieces. A task holds one slice of texts or the longest one.
sequence_id is unique and follows the order of the input's partitions; a repeated task gives the same ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import textkit as tk
from stratum.llm.common import arrow_map, table, vocabulary
from stratum.llm.encoding import encoder

SEQUENCE = 2048
END_ID = 1


def pieces(sizes: np.ndarray, longest: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in its row and length of every piece, for rows of the given sizes; longest is a power of two."""
    top = longest.bit_length() - 1
    rows, starts, lengths = [], [], []
    whole = sizes >> top
    row = np.repeat(np.arange(len(sizes)), whole)
    rows.append(row)
    starts.append((np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)) << top)
    lengths.append(np.full(len(row), longest))
    for bit in range(top - 1, -1, -1):
        row = np.flatnonzero(sizes >> bit & 1)
        rows.append(row)
        starts.append(sizes[row] >> (bit + 1) << (bit + 1))
        lengths.append(np.full(len(row), 1 << bit))
    rows, starts, lengths = (np.concatenate(x) for x in (rows, starts, lengths))
    order = np.lexsort((starts, rows))
    return rows[order], starts[order], lengths[order]


def pack(docs: DataFrame, path: str, longest: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket, sequence_id, offset, ids (little-endian uint32)."""

    def run(batches):
        for batch in batches:
            ids_of = encoder(path)
            for at, _, buf, offsets in tk.slices(batch.column(1)):
                flat, sizes = ids_of.encode(buf, offsets)
                ends = np.cumsum(sizes)
                flat = np.insert(flat, ends, np.uint32(end_id)).astype("<u4", copy=False)
                sizes = sizes + 1
                row, start, length = pieces(sizes, longest)
                # pieces stand in the order of their ids, so one buffer holds them all
                bounds = np.zeros(len(length) + 1, np.int64)
                np.cumsum(length * 4, out=bounds[1:])
                ids = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + at)), pa.array(start), pa.array(length), pa.array(sizes[row]), ids.cast(pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    out = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, start long, length long, doc_tokens long, ids binary", owner="encoding")
    bucket = F.log2("length").cast("int")
    return out.withColumn("bucket", bucket).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences in a folder for each length, ready to be batched by length."""
    packed.write.partitionBy("bucket").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))
