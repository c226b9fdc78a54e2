"""WARC archives, index first.

Writing returns an index row per record: file, byte offset and length of its gzip member, URL and payload digest.
Reading takes any selection of index rows, sorts them by file and offset, joins neighbouring ranges into few
larger reads, and checks each payload against its digest.

Defined cases: a null payload is empty; a null URL has no target header; a null page_id is kept and, in a group of
equal payloads, revisits the page with the largest id (if all ids are null, all are responses); rows that share
the largest id and the payload are all responses; extra columns are ignored; an empty table gives an empty index.
Each attempt of a task writes a file of its own, and only files named in the index count, so lost executors and
repeated tasks do no harm. A task holds one record, and one coalesced range of at most READ_BYTES (or one record).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, dealt, fresh_path, local_fs, materialize, small, table

#: Payloads shorter than this are always stored in full.
MIN_REVISIT_BYTES = 1000
#: Ranges closer than GAP_BYTES are read at once, up to READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Index rows of one file within the same block of this size go to one reader.
BLOCK_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "file string, offset long, length long, url string, payload_digest string, page_id long, record_type string"


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the rows whose payload another row stores; only narrow rows are shuffled."""
    html = F.coalesce(F.col("html"), F.lit(""))
    narrow = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes)
    kept = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
    kept = kept.where((F.col("copies") > 1) & F.col("refers_to").isNotNull()).drop("copies")
    found = narrow.drop("n").join(kept, "digest").where(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
    return found.select("page_id", "digest", "refers_to").distinct()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{digest}'.encode()).digest()[:16])}>"


def _record(page_id, url, payload: bytes, refers_to) -> tuple[bytes, str]:
    """A gzip member and the hex digest of the payload."""
    sha = hashlib.sha1(payload)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, sha.hexdigest())), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha.digest()).decode()))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, sha.hexdigest())), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    body = payload if refers_to is None else b""
    head += [("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    data = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(data.encode() + body + b"\r\n\r\n", 1, mtime=0), sha.hexdigest()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes a record per row into .warc.gz files below folder and returns the (materialised) index."""

    def run(batches):
        fs, root = local_fs(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    data, digest = _record(page, url, (html or "").encode(), refers)
                    out.write(data)
                    rows.append((name, at, len(data), url, digest, page, "response" if refers is None else "revisit"))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()], strict=True)], names=["file", "offset", "length", "url", "payload_digest", "page_id", "record_type"])
        finally:
            if out is not None:
                out.close()

    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    copies = materialize(revisits(pages, min_bytes), "warc-revisits")
    side = small(copies.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to"), copies.count(), 96)
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    joined = pages.withColumn("__d", digest).join(side, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("__d") == F.col("__digest")), "left")
    return materialize(arrow_map(joined.select("page_id", "url", "html", "refers_to"), run, _INDEX), "warc-index")


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[str, int, int, list[int]]]:
    """(file, offset, length, row numbers) of the reads that cover sorted (file, offset, length) rows."""
    out: list[tuple[str, int, int, list[int]]] = []
    for i, (file, offset, length) in enumerate(rows):
        if out and out[-1][0] == file and offset - (out[-1][1] + out[-1][2]) <= gap and offset + length - out[-1][1] <= most:
            _, start, _, members = out.pop()
            out.append((file, start, offset + length - start, [*members, i]))
        else:
            out.append((file, offset, length, [i]))
    return out


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *fields = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in fields)
    return headers, rest[: int(headers["Content-Length"])]


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows name, whichever are selected, by coalesced range reads."""

    def run(batches):
        fs, root = local_fs(folder)
        name, src = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for file, start, length, members in ranges(rows):
                if file != name:
                    name, src = file, fs.open_input_file(f"{root}/{file}")
                data = src.read_at(length, start)
                out = []
                for i in members:
                    at = rows[i][1] - start
                    head, block = parse(data[at : at + rows[i][2]])
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind, n = head["WARC-Type"], int(head["X-Payload-Length"])
                    if kind == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != n):
                        raise ValueError(f"damaged record in {file} at {rows[i][1]}")
                    page, refers, url = head.get("X-Page-Id"), head.get("X-Refers-To-Page"), head.get("WARC-Target-URI")
                    out.append((page and int(page), url, block, n, digest, kind, refers and int(refers)))
                types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    wanted = index.select("file", "offset", "length")
    total = wanted.agg(F.sum("length")).first()[0]
    rows = wanted.repartition(dealt(total), "file", F.expr(f"offset div {BLOCK_BYTES}")).sortWithinPartitions("file", "offset")
    return arrow_map(rows, run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long", 4096)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS keep FROM d GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.payload_bytes >= 1000 AND d.page_id < m.keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.payload_bytes >= 1000 AND d.page_id < m.keep THEN m.keep END AS refers_to
FROM d JOIN m ON d.payload_digest = m.payload_digest
"""
