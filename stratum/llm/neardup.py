"""Near-duplicate classes by ProbMinHash, banding and verification.

Weighted shingles (five words, weighted by how often they occur) give each document a ProbMinHash signature; bands
of it make buckets; similarities are then computed exactly, as probability Jaccard of the weighted shingles, and
links of THRESHOLD or more are closed to classes. Texts with equal word sequences (equal in two 64-bit hashes and in
the number of shingles) are one node from the start, so copies cost nothing beyond one narrow row each.

No bucket's pairs are listed. First every member of a bucket is compared with the bucket's most central member (the
one with most bucket mates over all bands). Then, in buckets that still hold more than one class, members outside
the central one's class are held in blocks, and the bucket's members stream past them, a part of them in each task: a pair is
skipped if it is in one class by now, if an earlier band has it too, or if the registers agree so rarely that it
cannot reach the threshold (LEAST_AGREE, 6 standard deviations below it); the rest are computed. Only links leave
the task. Blocks, parts and salted stars bound what a task group holds and deal a hot group over many tasks.

Defined cases: words are runs other than ASCII white space in ASCII lower case; a text of one to four words is one
shingle; a null text, or one without words, stays alone; repeated rows are in one class; a null doc_id may be a
member, and names its class only where all members lack one; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import shingles as sh
from stratum.llm import textkit as tk
from stratum.llm.common import arrow_map, materialize, small, table
from stratum.llm.components import components

THRESHOLD = 0.8
BANDS = 24
ROWS = 4
#: Share of equal registers below which a pair is not computed: a pair at the threshold has 0.8 of them, with a standard
#: deviation of 0.04, so it falls below with a probability (about 1e-8) far under that of sharing no band (3e-6).
LEAST_AGREE = 0.55
#: Members of one star, and held members of one block, per task group.
STAR = 250
BLOCK = 256
#: Members of a bucket that stream past one block within a task group.
PASSING = 256


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def sketch(docs: DataFrame, width: int = sh.WIDTH) -> DataFrame:
    """doc_id, key (hash of the text), words and words2 (hashes of the word sequence), n, bands, and 16 bits of each register."""

    def run(batches):
        for batch in batches:
            for at, end, buf, offsets in tk.slices(batch.column(2)):
                n = end - at
                row, hashes, weights, whole, second = sh.weighted(buf, offsets, width)
                registers = sh.signatures(row, hashes, weights, n, BANDS * ROWS)
                count = np.bincount(row, weights, n).astype(np.int64)
                bands = np.zeros((n, BANDS), np.uint64)
                grid = registers.reshape(n, BANDS, ROWS)
                for r in range(ROWS):
                    bands = tk.mix(bands * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, r])
                short = tk.mix(registers).astype("<u2").tobytes()
                size = 2 * BANDS * ROWS
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at:end], batch.column(1)[at:end], pa.array(whole.view(np.int64)), pa.array(second.view(np.int64)), pa.array(count),
                        tk.lists(np.full(n, BANDS), pa.array(bands.reshape(-1).view(np.int64))),
                        pa.array([short[i * size : (i + 1) * size] for i in range(n)], pa.binary()),
                    ],
                    names=["doc_id", "key", "words", "words2", "n", "bands", "registers"],
                )

    source = docs.select(F.col("doc_id").cast("long"), _key(F.col("text")).alias("key"), "text")
    return arrow_map(source, run, "doc_id long, key long, words long, words2 long, n long, bands array<long>, registers binary")


def _shingle_rows(docs: DataFrame, nodes: DataFrame, count: int, width: int) -> DataFrame:
    """(rid, hashes, weights) of the nodes, from their texts; nodes have rid, d and k (doc_id and key)."""

    def run(batches):
        for batch in batches:
            for at, end, buf, offsets in tk.slices(batch.column(1)):
                row, hashes, weights, *_ = sh.weighted(buf, offsets, width)
                cut = np.searchsorted(row, np.arange(end - at + 1))
                h = [hashes[cut[i] : cut[i + 1]].tobytes() for i in range(end - at)]
                w = [weights[cut[i] : cut[i + 1]].astype("<u4").tobytes() for i in range(end - at)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], pa.array(h, pa.binary()), pa.array(w, pa.binary())], names=["rid", "hashes", "weights"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    side = small(nodes, count, 40)
    texts = texts.join(side, texts["doc_id"].eqNullSafe(side["d"]) & (texts["key"] == side["k"]))
    # rows of one id and text are one node: any of them will do
    return arrow_map(texts.select("rid", "text"), run, "rid long, hashes binary, weights binary").groupBy("rid").agg(F.first("hashes").alias("hashes"), F.first("weights").alias("weights"))


def _similar(a: tuple, b: tuple, threshold: float) -> bool:
    """Whether two (hashes, weights, whether all weights are 1) reach the threshold."""
    if a[2] and b[2]:
        x, y = (a[0], b[0]) if len(a[0]) <= len(b[0]) else (b[0], a[0])
        if len(x) < threshold * len(y):
            return False
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = int(np.count_nonzero(y[at] == x))
        return common >= threshold * (len(x) + len(y) - common) - 1e-9
    return sh.probability_jaccard(a[0], a[1], b[0], b[1]) >= threshold - 1e-12


def _set(hashes: bytes, weights: bytes) -> tuple:
    w = np.frombuffer(weights, "<u4")
    return np.frombuffer(hashes, np.uint64), w, bool((w == 1).all())


_LINKS = "a long, b long"


def _links_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _star_links(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Links among pairs (center, rid). A center's members are dealt over salted groups; its own row leads each."""

    def run(batches):
        now, center = None, None
        for batch in batches:
            found = []
            groups, salts, rids, hashes, weights = (batch.column(i).to_pylist() for i in range(5))
            for group, salt, rid, h, w in zip(groups, salts, rids, hashes, weights, strict=True):
                if (group, salt) != now:
                    now, center = (group, salt), _set(h, w)
                elif _similar(center, _set(h, w), threshold):
                    found.append((group, rid))
            if found:
                yield _links_of(found)

    sizes = materialize(pairs.groupBy("center").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts")), "neardup-sizes")
    dealt = pairs.join(small(sizes, sizes.count(), 24), "center").select("center", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("turn"), "rid")
    heads = dealt.select("center", "salt").distinct().select("center", "salt", F.lit(0).alias("turn"), F.col("center").alias("rid"))
    full = dealt.unionByName(heads).join(rows, "rid")
    full = full.repartition("center", "salt").sortWithinPartitions("center", "salt", "turn", "rid")
    return arrow_map(full.select("center", "salt", "rid", "hashes", "weights"), run, _LINKS, 256)


def _block_links(members: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Links within buckets of several classes.

    members: band, h, rid, label, outside (not in the class of the bucket's center), blocks (of outside
    members) and parts (of all) of its bucket.
    """

    def run(batches):
        now, held, parent, grid, bands = None, [], {}, None, None
        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in range(11)]
            for band, h, block, part, turn, rid, label, hashes, weights, registers, all_bands in zip(*columns, strict=True):
                if (band, h, block, part) != now:
                    now, held, parent, grid = (band, h, block, part), [], {}, None
                regs, own = np.frombuffer(registers, "<u2"), np.array(all_bands, np.int64)
                mine = _set(hashes, weights)
                if turn == 0:
                    held.append((rid, label, mine, regs, own))
                    continue
                if grid is None:
                    grid, bands = np.stack([x[3] for x in held]), np.stack([x[4] for x in held])
                near = (grid == regs).mean(1) >= LEAST_AGREE
                if not near.any():
                    continue
                first = (bands == own).argmax(1)
                for i in np.flatnonzero(near & (first == band)).tolist():
                    other, its, its_set, *_ = held[i]
                    if other == rid or (turn == 2 and other > rid):
                        continue
                    x, y = _root(parent, its), _root(parent, label)
                    if x != y and _similar(its_set, mine, threshold):
                        parent[max(x, y)] = min(x, y)
                        found.append((other, rid))
            if found:
                yield _links_of(found)

    def dealt(n: str) -> Column:
        return F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # every block meets every part of its bucket in a group of its own
    holds = members.where("outside").select("band", "h", dealt("blocks").alias("block"), each("parts").alias("part"), F.lit(0).alias("turn"), "rid", "label")
    passing = members.select("band", "h", each("blocks").alias("block"), dealt("parts").alias("part"), F.when(F.col("outside"), 2).otherwise(1).alias("turn"), "rid", "label")
    full = holds.unionByName(passing).join(rows, "rid")
    group = ["band", "h", "block", "part"]
    full = full.repartition(*group).sortWithinPartitions(*group, "turn", "rid")
    return arrow_map(full.select(*group, "turn", "rid", "label", "hashes", "weights", "registers", "all_bands"), run, _LINKS, 256)


def _root(parent: dict, x: int) -> int:
    while x in parent:
        x = parent[x]
    return x


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = sh.WIDTH) -> DataFrame:
    """One row per document row: doc_id, key (hash of its text), class_id (least doc_id of its class), first (whether
    it is the row that stands for the class; of fully equal rows all are) and rid."""
    drawn = materialize(sketch(docs, width), "neardup-sketch").withColumn("rid", F.monotonically_increasing_id())
    # equal word sequences: texts without words are never equal
    same = ("words", "words2", "n")
    alone = F.when(F.col("n") == 0, F.col("rid")).otherwise(F.lit(-1))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "rid"))
    copies = drawn.select(*same, alone.alias("alone"), "doc_id", "rid").groupBy(*same, "alone").agg(least.alias("m"))
    copies = materialize(copies.select(*same, "alone", F.col("m.rid").alias("node"), F.col("m.doc_id").alias("node_doc")), "neardup-copies")

    nodes = drawn.where("n > 0").join(copies.select(F.col("node").alias("rid")), "rid", "left_semi")
    members = nodes.select("rid", F.posexplode("bands").alias("band", "h"))
    sizes = members.groupBy("band", "h").agg(F.count("*").alias("c")).where("c > 1")
    members = materialize(members.join(sizes, ["band", "h"]), "neardup-members")
    central = members.groupBy("rid").agg(F.sum("c").alias("mates"))
    ranked = members.join(central, "rid").groupBy("band", "h").agg(F.min(F.struct((-F.col("mates")).alias("m"), "rid"))["rid"].alias("center"))
    centered = materialize(members.drop("c").join(ranked, ["band", "h"]), "neardup-centered")
    pairs = materialize(centered.where("center != rid").select("center", "rid").distinct(), "neardup-pairs")

    wanted = materialize(central.select("rid").join(drawn.select("rid", F.col("doc_id").alias("d"), F.col("key").alias("k")), "rid"), "neardup-wanted")
    rows = materialize(_shingle_rows(docs, wanted, wanted.count(), width), "neardup-shingles")
    links = materialize(_star_links(pairs, rows, threshold), "neardup-stars")

    labels = components(links)
    named = centered.join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    heads = named.where("rid = center").select("band", "h", F.col("label").alias("head"))
    named = named.join(heads, ["band", "h"]).withColumn("outside", F.col("label") != F.col("head"))
    held = F.count(F.when(F.col("outside"), 1))
    open_ = named.groupBy("band", "h").agg(F.ceil(held / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / PASSING).cast("int").alias("parts")).where("blocks > 0")
    active = materialize(named.join(open_, ["band", "h"]).select("band", "h", "rid", "label", "outside", "blocks", "parts"), "neardup-active")
    full = rows.join(drawn.select("rid", "registers", F.col("bands").alias("all_bands")), "rid")
    more = materialize(_block_links(active, full, threshold), "neardup-blocks")
    labels = components(materialize(links.unionByName(more), "neardup-links"))

    # a class is named by the least id of its nodes, each of which has the least id of its copies
    named = copies.select("node", "node_doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.min(F.struct(F.col("node_doc").isNull().alias("u"), F.col("node_doc").alias("doc"), "node"))
    heads = named.groupBy("label").agg(order.alias("m")).select("label", F.col("m.doc").alias("class_id"), F.col("m.node").alias("head"))
    named = materialize(copies.join(named.select("node", "label"), "node").join(heads, "label").select(*same, "alone", "class_id", "head"), "neardup-classes")
    rows = drawn.select("doc_id", "key", "rid", *same, alone.alias("alone"))
    return rows.join(named, [*same, "alone"]).select("doc_id", "key", "class_id", (F.col("rid") == F.col("head")).alias("first"), "rid")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but the first of each class, otherwise unchanged.

    Rows that equal the kept one in id and text (but are not it) go as well.
    """
    found = materialize(classes(docs, threshold), "neardup-found")
    kept = found.where("first").select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"))
    again = found.groupBy(F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).agg(F.count("*").alias("__n"))
    kept = materialize(kept.join(again.withColumnsRenamed({"__doc": "d", "__key": "k"}), F.col("__doc").eqNullSafe(F.col("d")) & (F.col("__key") == F.col("k"))).select("__doc", "__key", "__n"), "neardup-kept")
    side = small(kept, kept.count(), 32)
    keyed = docs.withColumn("__k", _key(F.col("text")))
    out = keyed.join(side, keyed["doc_id"].cast("long").eqNullSafe(side["__doc"]) & (keyed["__k"] == side["__key"]))
    if kept.where("__n > 1").isEmpty():
        return out.select(*docs.columns)
    plain = out.where("__n = 1").select(*docs.columns)
    return plain.unionByName(out.where("__n > 1").dropDuplicates(["__doc", "__key"]).select(*docs.columns))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
