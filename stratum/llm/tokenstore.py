"""Content-addressed store of token ids.

Each document's ids, with an end id, are cut into chunks where a rolling hash of the last ids says so. A chunk is
named by its digest; equal chunks, within a document or across the corpus, are stored once. A recipe per document,
in ascending doc_id order, lists its chunks, and Merkle roots over chunks, documents and the whole table let a
reader verify what it rebuilds.

Layout below the store's folder:
    packs/<name>.pack   "CIDS" + width byte, then the raw little-endian ids of the pack's chunks
    index/              digest, pack, offset, ids (Parquet): one row per stored chunk
    recipes/            doc_id, n_tokens, chunks, after, root, run, local_start (Parquet), in ascending doc_id order by run
    manifest/           run, start, n_tokens, root of the run, root of the table (Parquet)

Writing encodes each text once. Tasks write packs without their own repeats into a folder first/; then every digest
found in several packs gets one owner, the owned chunks are copied to the final packs, and first/ is deleted.
Reading takes each stored chunk once, checks its digest, and combines the chunks' checksums along the recipes, so
no id crosses the network.

Defined cases: a null text is an empty one and holds the end id alone; a null doc_id sorts first; rows that share a
doc_id are ordered by their root; extra columns are ignored; an empty table gives an empty store. Files are named
by attempt and only what the index names counts, so lost executors do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratum.llm import textkit as tk
from stratum.llm.common import arrow_map, dealt, drop_materialized, fresh_path, local_fs, materialize, table, vocabulary
from stratum.llm.encoding import encoder

END_ID = 2
#: ids under the rolling hash, mean chunk length (a power of two) and its limits, in ids.
WINDOW = 16
MEAN = 512
SHORTEST = 64
LONGEST = 4096
DIGEST_BYTES = 20
MAGIC = b"CIDS"
#: Chunks of one pack within the same block of this size go to one reader.
BLOCK_BYTES = 8 << 20
#: Bytes of ids whose recipes make one run.
RUN_BYTES = 1 << 30

_CRC_POLY = 0xEDB88320
_ID_MIX = np.uint64(0x9E3779B97F4A7C15)
#: What ids below 2**16 add to the rolling hash; larger ones are computed.
_SMALL_IDS = tk.mix(np.arange(1 << 16, dtype=np.uint64) * _ID_MIX + np.uint64(1))


def cuts(ids: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """Chunk ends of each document, relative to it; they depend on nothing but the document's own ids."""
    small = len(ids) and int(ids.max()) < len(_SMALL_IDS)
    rolling = _SMALL_IDS[ids] if small else tk.mix(ids.astype(np.uint64) * _ID_MIX + np.uint64(1))
    step = 1
    while step < WINDOW:
        longer = rolling * np.uint64(pow(0xD6E8FEB86659FD93, step, 1 << 64))
        longer[step:] += rolling[:-step]
        rolling = longer
        step *= 2
    marks = np.flatnonzero(tk.mix(rolling) >> np.uint64(64 - (MEAN.bit_length() - 1)) == 0) + 1
    ends = np.cumsum(sizes)
    out = []
    for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        mine, last = [], start
        # a mark counts only where its whole window lies in the document
        lo, hi = np.searchsorted(marks, [start + WINDOW, end])
        for m in [*marks[lo:hi].tolist(), end]:
            while m - last > LONGEST:
                last += LONGEST
                mine.append(last - start)
            if m - last >= SHORTEST or m == end:
                mine.append(m - start)
                last = m
        out.append(mine)
    return out


class Merkle:
    """Root of a binary hash tree over leaves that come one by one; only the roots of full subtrees are held. The leaves
    and the inner nodes are told apart by a first byte; a node without a neighbour moves up as it is."""

    def __init__(self) -> None:
        self.held: list[tuple[int, bytes]] = []

    def add(self, digest: bytes) -> None:
        height, node = 0, hashlib.sha256(b"\0" + digest).digest()
        while self.held and self.held[-1][0] == height:
            node = hashlib.sha256(b"\1" + self.held.pop()[1] + node).digest()
            height += 1
        self.held.append((height, node))

    def root(self) -> bytes:
        if not self.held:
            return hashlib.sha256(b"").digest()
        node = self.held[-1][1]
        for _, left in reversed(self.held[:-1]):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def merkle(digests: list[bytes]) -> bytes:
    tree = Merkle()
    for d in digests:
        tree.add(d)
    return tree.root()


def chunk_digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST_BYTES).digest()


class _Pack:
    """A pack file of one task attempt."""

    def __init__(self, folder: str, width: int):
        self.fs, root = local_fs(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.pack"
        self.path = f"{root}/{self.name}"
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.out.write(MAGIC + bytes([width]))
        self.at = len(MAGIC) + 1

    def add(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)


def _encode(docs: DataFrame, folder: str, path: str, end_id: int, width: int) -> DataFrame:
    """Writes packs and returns doc_id, chunk digests and sizes, and which chunks the task stored where."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches):
        pack, known = None, set()
        for batch in batches:
            ids_of = encoder(path)
            for at, end, buf, offsets in tk.slices(batch.column(1)):
                flat, sizes = ids_of.encode(buf, offsets)
                flat = np.insert(flat, np.cumsum(sizes), np.uint32(end_id))
                sizes = sizes + 1
                pack = pack or _Pack(f"{folder}/first", width)
                data, start, rows = flat.astype(kind).tobytes(), 0, []
                for n, ends in zip(sizes.tolist(), cuts(flat, sizes), strict=True):
                    digests, lengths, after, places, last = [], [], [], [], 0
                    for e in ends:
                        chunk = data[(start + last) * width : (start + e) * width]
                        d = chunk_digest(chunk)
                        digests.append(d)
                        lengths.append(e - last)
                        after.append(n - e)
                        if d not in known:
                            known.add(d)
                            places.append(pack.add(chunk))
                        else:
                            places.append(-1)
                        last = e
                    start += n
                    rows.append((n, digests, lengths, after, places, merkle(digests), pack.name))
                kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], *columns], names=["doc_id", "n_tokens", "chunks", "sizes", "after", "places", "root", "pack"])
        if pack:
            pack.out.close()

    schema = "doc_id long, n_tokens long, chunks array<binary>, sizes array<int>, after array<long>, places array<long>, root binary, pack string"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, schema, owner="encoding")


def _compact(owned: DataFrame, total: int, folder: str, width: int) -> DataFrame:
    """Copies the owned chunks of each task's packs into new packs; returns the index."""

    def run(batches):
        fs, root = local_fs(f"{folder}/first")
        pack, name, src = None, None, None
        for batch in batches:
            rows = []
            for digest, old, place, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if old != name:
                    name, src = old, fs.open_input_file(f"{root}/{old}")
                pack = pack or _Pack(f"{folder}/packs", width)
                data = src.read_at(n * width, place)
                if chunk_digest(data) != digest:
                    raise ValueError(f"damaged chunk in {old} at {place}")
                rows.append((digest, pack.name, pack.add(data), n))
            if rows:
                kinds = [pa.binary(), pa.string(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["digest", "pack", "place", "ids"])
        if pack:
            pack.out.close()

    rows = owned.select("digest", "pack", "place", "ids")
    rows = rows.repartition(dealt(total * width), "pack", F.expr(f"place div {BLOCK_BYTES}")).sortWithinPartitions("pack", "place")
    return arrow_map(rows, run, "digest binary, pack string, place long, ids int", 4096)


def _runs(recipes: DataFrame, total: int) -> DataFrame:
    """Recipes in ascending doc_id order: run (the range they fall in), local_start (ids before them in it), and on
    its last row the run's Merkle root over its documents."""

    def run(batches):
        at, me, roots, held = 0, TaskContext.get().partitionId(), Merkle(), None
        for batch in batches:
            if held is not None:
                yield held
            n = batch.column("n_tokens").to_numpy()
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            for root in batch.column("root").to_pylist():
                roots.add(root)
            held = pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), me)), pa.array(start), pa.nulls(len(n), pa.binary())], names=[*batch.schema.names, "run", "local_start", "run_root"])
        if held is not None:
            last = pa.array([None] * (held.num_rows - 1) + [roots.root()], pa.binary())
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], last], names=held.schema.names)

    # ranges are cut by id and root, so rows that share an id may be dealt out too
    order = [F.col("doc_id").asc_nulls_first(), F.col("root")]
    # as many ranges as the ids ask for: a recipe has about a 25th of their bytes
    n = max(int(recipes.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt(4 * total, RUN_BYTES))
    ranged = recipes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = StructType([*recipes.schema.fields]).add("run", "long").add("local_start", "long").add("run_root", "binary")
    return arrow_map(ranged, run, schema, 4096)


def write_store(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Encodes the documents into a new store at folder (a URI that driver and executors share)."""
    spark = docs.sparkSession
    width = 2 if max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    encoded = materialize(_encode(docs, folder, path, end_id, width), "store-encoded")
    placed = encoded.select("pack", F.explode(F.arrays_zip("chunks", "places", "sizes")).alias("c")).where("c.places >= 0")
    placed = placed.select(F.col("c.chunks").alias("digest"), "pack", F.col("c.places").alias("place"), F.col("c.sizes").alias("ids"))
    owners = placed.groupBy("digest").agg(F.min(F.struct("pack", "place", "ids")).alias("o")).select("digest", "o.*")
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    _compact(owners, total, folder, width).write.parquet(f"{folder}/index")
    first = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/first")
    first.getFileSystem(spark._jsc.hadoopConfiguration()).delete(first, True)
    _runs(encoded.select("doc_id", "n_tokens", "chunks", "after", "root"), total).write.parquet(f"{folder}/recipes")
    drop_materialized(encoded)

    # a row per run
    recipes = spark.read.parquet(f"{folder}/recipes")
    per_run = recipes.groupBy("run").agg(F.sum("n_tokens").alias("n"), F.max("run_root").alias("root")).orderBy("run").collect()
    rows, at = [], 0
    for r in per_run:
        rows.append((r["run"], at, r["n"], bytes(r["root"])))
        at += r["n"]
    top = merkle([r[3] for r in rows])
    spark.createDataFrame([(*r, top) for r in rows], "run long, start long, n_tokens long, run_root binary, root binary").coalesce(1).write.parquet(f"{folder}/manifest")


def _crc_tables() -> list[np.ndarray]:
    """For each k the linear map that appends 2**k zero bytes to a CRC-32, as four tables of 256."""
    one = np.zeros(32, np.uint64)
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (_CRC_POLY if c & 1 else 0)
        one[bit] = c

    def apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for bit in range(32):
            out ^= np.where(x >> np.uint64(bit) & np.uint64(1), matrix[bit], np.uint64(0))
        return out

    out = []
    for _ in range(48):
        out.append(np.stack([apply(one, np.arange(256, dtype=np.uint64) << np.uint64(8 * b)) for b in range(4)]))
        one = apply(one, one)
    return out


def crc_after(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a text in which it is followed by so many more bytes."""
    global _tables
    if _tables is None:
        _tables = _crc_tables()
    crc, zeros = crc.astype(np.uint64), zeros.astype(np.uint64)
    for k, table_ in enumerate(_tables):
        at = np.flatnonzero(zeros >> np.uint64(k) & np.uint64(1))
        if len(at):
            x = crc[at]
            crc[at] = table_[0][x & np.uint64(255)] ^ table_[1][x >> np.uint64(8) & np.uint64(255)] ^ table_[2][x >> np.uint64(16) & np.uint64(255)] ^ table_[3][x >> np.uint64(24)]
    return crc


_tables: list[np.ndarray] | None = None


def _stored(index: DataFrame, folder: str, with_data: bool = False) -> DataFrame:
    """(digest, n, crc) of every stored chunk, read from its pack and checked; crc is over uint32 ids, data holds them."""

    def run(batches):
        fs, root = local_fs(f"{folder}/packs")
        name, src, kind = None, None, ""
        for batch in batches:
            digests, packs, places, counts = (batch.column(i).to_pylist() for i in range(4))
            crcs, held = [], []
            for digest, pack, place, n in zip(digests, packs, places, counts, strict=True):
                if pack != name:
                    name, src = pack, fs.open_input_file(f"{root}/{pack}")
                    head = src.read_at(5, 0)
                    if head[:4] != MAGIC:
                        raise ValueError(f"{pack} is no pack")
                    kind = f"<u{head[4]}"
                data = src.read_at(n * int(kind[2:]), place)
                if chunk_digest(data) != digest:
                    raise ValueError(f"damaged chunk in {pack} at {place}")
                ids = np.frombuffer(data, kind).astype("<u4").tobytes()
                crcs.append(zlib.crc32(ids))
                held.append(ids if with_data else None)
            columns = [batch.column(0), batch.column(3).cast(pa.int64()), pa.array(crcs, pa.int64()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "n", "crc", "data"])

    total = index.agg(F.sum("ids")).first()[0] or 0
    rows = index.select("digest", "pack", "place", "ids")
    rows = rows.repartition(dealt(2 * total), "pack", F.expr(f"place div {BLOCK_BYTES}")).sortWithinPartitions("pack", "place")
    return arrow_map(rows, run, "digest binary, n long, crc long, data binary", 4096)


def _references(recipes: DataFrame) -> DataFrame:
    """A row per chunk of each document whose root is right: doc_id, start, n_tokens, digest, ids after the chunk."""

    def run(batches):
        for batch in batches:
            doc, start, n, chunks, after, roots = (batch.column(k) for k in ("doc_id", "start", "n_tokens", "chunks", "after", "root"))
            for digests, root in zip(chunks.to_pylist(), roots.to_pylist(), strict=True):
                if merkle(digests) != root:
                    raise ValueError("a recipe does not have its root")
            row = pa.compute.list_parent_indices(chunks)
            yield pa.RecordBatch.from_arrays([doc.take(row), start.take(row), n.take(row), pa.compute.list_flatten(chunks), pa.compute.list_flatten(after)], names=["doc_id", "start", "whole", "digest", "after"])

    return arrow_map(recipes, run, "doc_id long, start long, whole long, digest binary, after long", 4096)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Per document doc_id, start, n_tokens and ids_crc32, from the store's files; a missing or damaged chunk stops the job."""

    def shift(batches):
        for batch in batches:
            got = crc_after(batch.column("crc").to_numpy(), batch.column("after").to_numpy() * 4).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "start", "whole", "n")), pa.array(got)], names=["doc_id", "start", "whole", "n", "part"])

    stored = _stored(spark.read.parquet(f"{folder}/index"), folder)
    recipes, manifest = spark.read.parquet(f"{folder}/recipes"), spark.read.parquet(f"{folder}/manifest")
    starts = F.broadcast(manifest.select("run", F.col("start").alias("run_start")))  # a row per range
    recipes = recipes.join(starts, "run").withColumn("start", F.col("run_start") + F.col("local_start"))
    joined = _references(recipes.drop("run_root")).join(stored, "digest")
    parts = arrow_map(joined.select("doc_id", "start", "whole", "n", "crc", "after"), shift, "doc_id long, start long, whole long, n long, part long", 4096)
    out = parts.groupBy("doc_id", "start", "whole").agg(F.sum("n").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"))
    whole = F.when(F.col("n_tokens") == F.col("whole"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a chunk is missing")).cast("long"))
    return out.select("doc_id", "start", whole.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids (little-endian uint32) rebuilt for every document."""
    recipes, manifest = spark.read.parquet(f"{folder}/recipes"), spark.read.parquet(f"{folder}/manifest")
    starts = F.broadcast(manifest.select("run", F.col("start").alias("run_start")))
    recipes = recipes.join(starts, "run").withColumn("start", F.col("run_start") + F.col("local_start"))
    joined = _references(recipes.drop("run_root")).join(_stored(spark.read.parquet(f"{folder}/index"), folder, True), "digest")
    grouped = joined.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("at"), "data"))).alias("c"))
    return grouped.select("doc_id", "start", F.aggregate("c", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"])).alias("ids"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"))
    return read_store(spark, folder)
