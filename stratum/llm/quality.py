"""Quality rules: cross-document line frequency.

Lines are normalised (ASCII lower case, digits as 0, white space collapsed) and hashed; for each host the
distinct documents that hold a line are counted; lines in too many of them are removed, and a document that
loses most of its words with them is rejected.

Defined cases: a null text is an empty one and fails the base rule; a null host is a host of its own; repeated
rows each get a row, and exact copies of a text on one host count as one document, so that copies (another
operator's work) never make their own lines look like boilerplate; extra columns are ignored; an empty table
gives an empty result. Memory of a task follows its longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import textkit as tk
from stratum.llm.common import arrow_map, materialize, small, table

#: A line is removed on a host if more than this share of its documents, and more than LINE_FLOOR, hold it.
LINE_SHARE = 0.05
LINE_FLOOR = 20
#: A line also goes on a host if more distinct documents than this hold it, however many the host has.
#: Published line filters go as low as 6 in 30 million documents.
LINE_MOST = 100
#: A document is depleted if more than this share of its words stands in removed lines.
DEPLETED_SHARE = 0.7
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48

_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeats(buf: np.ndarray, held: tk.Strings, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each line equals an earlier one of its row: by hash, then byte by byte."""
    order = np.lexsort((held.hash, row))
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((row[a] == row[b]) & (held.hash[a] == held.hash[b]))
    out = np.zeros(len(row), bool)
    out[b[near]] = True
    if not held.equal(a[near], held, b[near]).all():
        # different lines with one hash: compare the texts themselves
        seen = set()
        for i, key in enumerate(zip(row.tolist(), (buf[x:y].tobytes() for x, y in zip(start.tolist(), end.tolist(), strict=True)), strict=True)):
            out[i] = key in seen
            seen.add(key)
    return out


def measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of each text, and of its lines with words the row, hash, words, start and end."""
    n = len(offsets) - 1
    starts, ends = tk.words(buf, offsets)
    wrow = tk.rows_of(starts, offsets)
    solid = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~tk.SPACE[buf] & ((buf & 0xC0) != 0x80), out=solid[1:])
    symbols = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_SYMBOLS[buf], out=symbols[1:])
    lrow, lstart, lend = tk.lines(buf, offsets)
    lfirst, llast = np.searchsorted(starts, lstart), np.searchsorted(starts, lend)
    full = llast > lfirst
    lrow, lstart, lend, lfirst, llast = (x[full] for x in (lrow, lstart, lend, lfirst, llast))

    again = _repeats(buf, tk.strings_of(buf, lstart, lend), lrow, lstart, lend)

    exact = tk.strings_of(buf, starts, ends).hash
    first, hashes = tk.windows(exact, wrow, WINDOW)
    keys = hashes ^ tk.mix(wrow[first].astype(np.uint64) + np.uint64(1))
    ranked = np.sort(keys)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = first[twice[at] == keys]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    repeated = np.cumsum(covered)[:-1] > 0

    folded = tk.strings_of(_FOLD[buf], starts, ends).hash
    return {
        "n_words": np.bincount(wrow, minlength=n)[:n].astype(np.int64),
        "word_chars": solid[offsets[1:]] - solid[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": tk.per_row(again, lrow, n),
        "n_repeat_words": tk.per_row(repeated, wrow, n),
        "line_row": lrow,
        "line_hash": tk.sequence_hashes(folded, lfirst, llast).view(np.int64),
        "line_words": (llast - lfirst).astype(np.int64),
        "line_start": lstart,
        "line_end": lend,
        "text_hash": tk.strings_of(buf, offsets[:-1], offsets[1:]).hash.view(np.int64),
    }


def _line_sums(m: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lines of each row: how many, their hashes and the words they hold in it."""
    order = np.lexsort((m["line_hash"], m["line_row"]))
    row, key, count = m["line_row"][order], m["line_hash"][order], m["line_words"][order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return np.bincount(row[at], minlength=n), key[at], np.add.reduceat(count, at) if len(at) else count[:0]


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def profile(docs: DataFrame) -> DataFrame:
    """One row per document: host, measures, hash of the text, and its distinct lines with their words;
    key is a hash by which rows are found again."""

    def run(batches):
        for batch in batches:
            for at, end, buf, offsets in tk.slices(batch.column(3)):
                m = measure(buf, offsets)
                counts, keys, held = _line_sums(m, end - at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k)[at:end] for k in range(3)]
                    + [pa.array(m[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash")]
                    + [tk.lists(counts, pa.array(keys)), tk.lists(counts, pa.array(held))],
                    names=["doc_id", "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash", "line_hashes", "line_words"],
                )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("host"), _key(F.col("text")).alias("key"), "text")
    return arrow_map(docs, run, f"doc_id long, host string, key long, {_MEASURES}, text_hash long, line_hashes array<long>, line_words array<long>")


def frequent_lines(profiled: DataFrame, share: float = LINE_SHARE, floor: int = LINE_FLOOR, most: int | None = LINE_MOST) -> DataFrame:
    """(host, line) of the lines that stand in too many distinct documents of their host: more than `floor` and the
    share, or more than `most` if that is given.

    Exact copies on a host are counted once: the first of each text is found on narrow rows, and only its lines
    are exploded. Counts are combined before each shuffle, so a hot host or line sends one row per task.
    """
    # a text is told by two unrelated 64-bit hashes and its counts
    firsts = profiled.groupBy("host", "key", "text_hash", "n_words", "word_chars").agg(F.min("rid").alias("rid"))
    firsts = materialize(firsts.select("rid", "host"), "quality-firsts")
    hosts = firsts.groupBy("host").agg(F.count("*").alias("host_docs"))
    one = profiled.select("rid", "host", "line_hashes").join(firsts.select("rid"), "rid", "left_semi")
    counts = one.select("host", F.explode("line_hashes").alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs"))
    counts = counts.where(F.col("docs") > (floor if most is None else min(floor, most)))
    joined = counts.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    often = (F.col("docs") > floor) & (F.col("docs") > share * F.col("host_docs"))
    return joined.where(often if most is None else often | (F.col("docs") > most)).select("host", "line", "docs", "host_docs")


def judge(docs: DataFrame, share: float = LINE_SHARE, floor: int = LINE_FLOOR, depleted: float = DEPLETED_SHARE, most: int | None = LINE_MOST) -> tuple[DataFrame, DataFrame]:
    """(verdicts, removed lines): a row for each document row, and (doc_id, host, lines) where lines are removed."""
    profiled = materialize(profile(docs), "quality-profile").withColumn("rid", F.monotonically_increasing_id())
    common = materialize(frequent_lines(profiled, share, floor, most), "quality-lines")
    n = common.count()
    held = profiled.select("rid", "doc_id", F.col("host").alias("h"), F.explode(F.arrays_zip("line_hashes", "line_words")).alias("x"))
    held = held.select("rid", "doc_id", "h", F.col("x.line_hashes").alias("key"), F.col("x.line_words").alias("w"))
    side = small(common.select("host", "line"), n, 64)
    hits = held.join(side, held["key"].eqNullSafe(side["line"]) & held["h"].eqNullSafe(side["host"]))
    hits = hits.groupBy("rid", "doc_id", "host").agg(F.sum("w").alias("removed_words"), F.collect_set("line").alias("lines"))
    hits = materialize(hits, "quality-hits")
    m = hits.count()
    lost = small(hits.select("rid", "removed_words"), m, 64)
    out = profiled.drop("line_hashes", "line_words", "text_hash").join(lost, "rid", "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~failed & ~(F.col("removed_words") > depleted * F.col("n_words")))
    return out.drop("rid"), hits.select("doc_id", "host", "lines")


def strip_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents without their removed lines; a document that loses none keeps its text as it is;
    n_chars follows the text."""

    def run(batches):
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("__lines").to_pylist()
            out = texts.to_pylist()
            for at, end, buf, offsets in tk.slices(texts):
                if not any(lists[at:end]):
                    continue
                m = measure(buf, offsets)
                first = np.searchsorted(m["line_row"], np.arange(end - at + 1))
                for i in range(end - at):
                    if not lists[at + i]:
                        continue
                    mine = slice(first[i], first[i + 1])
                    gone = np.isin(m["line_hash"][mine], np.array(lists[at + i], np.int64))
                    cut = {int(s - offsets[i]) for s in m["line_start"][mine][gone]}
                    text, pos, kept = buf[offsets[i] : offsets[i + 1]].tobytes(), 0, []
                    for line in text.split(b"\n"):
                        if pos not in cut:
                            kept.append(line)
                        pos += len(line) + 1
                    out[at + i] = b"\n".join(kept).decode()
            changed = {"text": pa.array(out, pa.string())}
            if "n_chars" in names and any(lists):
                sizes = zip(batch.column("n_chars").to_pylist(), out, lists, strict=True)
                changed["n_chars"] = pa.array([len(t) if gone and t is not None else n for n, t, gone in sizes], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([changed.get(n, batch.column(n)) for n in names], names=names)

    names = docs.columns
    lines = removed.groupBy(F.col("doc_id").alias("__doc"), F.col("host").alias("__host")).agg(F.flatten(F.collect_list("lines")).alias("__lines"))
    lines = materialize(lines, "quality-strip")
    lines = small(lines, lines.count(), 128)
    same = docs["doc_id"].cast("long").eqNullSafe(lines["__doc"]) & docs["source"].cast("string").eqNullSafe(lines["__host"])
    joined = docs.join(lines, same, "left").drop("__doc", "__host")
    return arrow_map(joined, run, docs.schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, without the lines that they remove."""
    verdicts, removed = judge(docs)
    bad = verdicts.where("not kept").select(F.col("doc_id").alias("__doc"), F.col("host").alias("__host"), F.col("key").alias("__key"))
    bad = materialize(bad.distinct(), "quality-rejected")
    side = small(bad, bad.count(), 64)
    keyed = docs.withColumn("__k", _key(F.col("text")))
    same = keyed["doc_id"].cast("long").eqNullSafe(side["__doc"]) & keyed["source"].cast("string").eqNullSafe(side["__host"]) & (keyed["__k"] == side["__key"])
    return strip_lines(keyed.join(side, same, "left_anti").drop("__k"), removed)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = judge(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


_FOLDED_SQL = "regexp_replace(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g')"
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, source, text) AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, generate_subscripts(ls, 1) AS ln, unnest(ls) AS line FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM d) x),
lw AS (SELECT rid, ln, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
w AS (SELECT rid, ln, generate_subscripts(ws, 1) AS k, unnest(ws) AS word FROM lw WHERE len(ws) > 0),
p AS (SELECT rid, ln, k, word, row_number() OVER (PARTITION BY rid ORDER BY ln, k) AS pos FROM w),
lines AS (SELECT rid, ln, string_agg({_FOLDED_SQL}, ' ' ORDER BY k) AS folded, count(*) AS n FROM w GROUP BY rid, ln),
base AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup FROM lw WHERE len(ws) > 0 GROUP BY rid),
g AS (SELECT rid, pos, gram FROM (SELECT rid, pos, word || chr(10) || lead(word, 1) OVER w || chr(10) || lead(word, 2) OVER w || chr(10) || lead(word, 3) OVER w || chr(10) || lead(word, 4) OVER w
      || chr(10) || lead(word, 5) OVER w || chr(10) || lead(word, 6) OVER w || chr(10) || lead(word, 7) OVER w AS gram FROM p WINDOW w AS (PARTITION BY rid ORDER BY pos)) q WHERE gram IS NOT NULL),
twice AS (SELECT rid, gram FROM g GROUP BY rid, gram HAVING count(*) > 1),
spots AS (SELECT g.rid, g.pos FROM g JOIN twice t ON t.rid = g.rid AND t.gram = g.gram),
covered AS (SELECT DISTINCT s.rid, s.pos + o.o AS pos FROM spots s CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS o) o),
rep AS (SELECT rid, count(*) AS n_repeat FROM covered GROUP BY rid),
hosts AS (SELECT coalesce(source, '-null-') AS host, count(DISTINCT text) AS docs FROM d GROUP BY 1),
held AS (SELECT coalesce(d.source, '-null-') AS host, folded, count(DISTINCT d.text) AS docs FROM lines JOIN d ON d.rid = lines.rid GROUP BY 1, 2),
common AS (SELECT held.host, folded FROM held JOIN hosts ON hosts.host = held.host WHERE (held.docs > {LINE_FLOOR} AND held.docs > {LINE_SHARE} * hosts.docs) OR held.docs > {LINE_MOST}),
gone AS (SELECT lines.rid, sum(lines.n) AS removed FROM lines JOIN d ON d.rid = lines.rid JOIN common c ON c.host = coalesce(d.source, '-null-') AND c.folded = lines.folded GROUP BY lines.rid),
o AS (SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
      FROM d LEFT JOIN base ON base.rid = d.rid LEFT JOIN dup ON dup.rid = d.rid LEFT JOIN rep ON rep.rid = d.rid LEFT JOIN gone ON gone.rid = d.rid)
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND NOT (removed_words > {DEPLETED_SHARE} * n_words) AS kept
FROM o
"""
