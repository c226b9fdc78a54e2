"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a WINDOW-byte string over it also starts earlier: in a row with a smaller doc_id, or earlier in the
same row. Strings are judged on the input.

Every WINDOW-byte string has an anchor, the position in it of the GRAM-byte string with the least hash (the leftmost
of equals; ANCHOR_BITS of the hash count), which depends on nothing but the string itself; neighbouring strings mostly
share one. A cell is a maximal run of strings with one anchor. So equal strings lie at the same place in cells with
equal anchor grams, and the longest previous factor is found in two steps, as when suffixes are sorted by naming
substrings first:

1. cells (hashes and positions only) are dealt out by their gram and named by their content. In the order of names, the
   positions of one name are a run with common prefixes of WINDOW or more, and the previous smaller position in it is
   an earlier match for all strings of the cell; all but the earliest cell of a name are thus repeats as a whole. A
   name is 96 bits of hash with the strings and the anchor's place; the bytes behind equal names are not compared
   again. Cells whose gram no other name has need no more work;
2. of the others, the earliest of each name is read from its text, cut into the part whose strings reach
   further left and the part whose strings reach further right of the anchor, and dealt out by the bytes that all of
   the part's strings hold. There the strings are put in suffix order (their positions sorted by content, capped at
   WINDOW bytes), and a string has an earlier match, i.e. its longest previous factor is WINDOW or more, if the
   previous or the next smaller position in suffix order lies within the same run of common prefixes of WINDOW or
   more. The strings of a gram with more than HOT names (the edge of a passage that a third of all documents hold) are
   no one task's work: they are named as cells are and their names sorted over the cluster, with the same test on
   neighbours.

A slice of texts sends each content once and settles its own repeats. No text is shuffled in step 1; in step 2 and
in the end the same exchange of texts serves both. Groups of grams grow in number with the input; they are sorted, one
after the other, within at most MOST_PARTITIONS partitions, and a worker holds HELD_BYTES of a group at a time.

Defined cases: a null text is empty; a null doc_id comes before all others; rows that share a doc_id are told apart
and ordered by their place in the input (which is written first unless it only reads files); texts shorter than WINDOW lose
nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from stratum.llm import textkit as tk
from stratum.llm.common import arrow_map, materialize, small, strings, table

WINDOW = 100
GRAM = 32
#: Bytes of text for each group of grams, and of cell parts that are put in order at once.
GROUP_BYTES = 8 << 20
ORDER_BYTES = 2 << 20
MOST_PARTITIONS = 16_384
#: Bytes of cells of one group that a worker holds before it settles what it has.
HELD_BYTES = 64 << 20
#: Names that may share a gram before its strings are put in suffix order over the cluster.
HOT = 20_000
_HOT_LEAD = 128
#: Bits of a gram's hash that choose the anchor; the others hold a position within a stretch.
ANCHOR_BITS = 44

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_CELL = np.dtype([("content", "<u8"), ("tag", "<u4"), ("n", "u1"), ("lead", "u1"), ("start", "<u4"), ("doc", "<i8"), ("rid", "<i8")])
_FIRST_DOC = -(1 << 63)


def _doubled(buf: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the strings of 32 and 64 bytes at every position, by doubling."""
    at, size, out = tk.BYTE_VALUES[buf], 1, {}
    for m in _MULTIPLIERS:
        n = max(0, len(at) - size)
        at = at[:n] * np.uint64(m) + at[size : size + n]
        at ^= at >> np.uint64(29)
        size *= 2
        out[size] = at
    return out


#: Strings whose anchors are looked for at once; with the grams of the last one they fit the bits of a position.
_STRETCH = (1 << 64 - ANCHOR_BITS) - WINDOW


def _anchors(gram: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of each `span` hashes by their first ANCHOR_BITS, the leftmost of equals."""
    bits = np.uint64(64 - ANCHOR_BITS)
    least = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: -(span - size)], least[span - size :])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def cells(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, strings, anchor - start, gram hash, content hash) of every cell of the texts."""
    count = len(buf) - WINDOW + 1
    empty = np.zeros(0, np.int64)
    if count <= 0:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    hashes = _doubled(buf)
    gram = tk.mix(hashes[GRAM])
    span = WINDOW - GRAM + 1
    anchor = np.concatenate([_anchors(gram[a : a + _STRETCH + span - 1], span) + a for a in range(0, count, _STRETCH)])
    ok = np.zeros(count, bool)
    full = np.flatnonzero(np.diff(offsets) >= WINDOW)
    edges = np.zeros(count + 1, np.int64)
    np.add.at(edges, offsets[full], 1)
    np.add.at(edges, offsets[full + 1] - WINDOW + 1, -1)
    ok[:] = np.cumsum(edges[:-1]) > 0
    change = np.ones(count, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(ok & change)
    stop = np.ones(count, bool)
    stop[:-1] = (anchor[1:] != anchor[:-1]) | ~ok[1:]
    ends = np.flatnonzero(ok & stop)
    whole = lambda at: tk.mix(hashes[64][at] * np.uint64(_MULTIPLIERS[0]) + hashes[64][at + WINDOW - 64])
    n = ends - starts + 1
    content = tk.mix(whole(starts) * np.uint64(3) + whole(ends) + n.astype(np.uint64))
    return tk.rows_of(starts, offsets), starts, n, anchor[starts] - starts, gram[anchor[starts]], content


def _repeatable(docs: DataFrame) -> DataFrame:
    """docs itself if it only reads files, whose rows keep their places; else a written copy."""

    def plain(node) -> bool:
        kids = node.children()
        return node.nodeName().split()[0] in ("LogicalRelation", "Relation", "Project", "Filter") and all(plain(kids.apply(i)) for i in range(kids.size()))

    return docs if plain(docs._jdf.queryExecution().optimizedPlan()) else materialize(docs, "suffix-input")


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__rid", F.monotonically_increasing_id()).withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_DOC)))


def _sent_cells(docs: DataFrame, groups: int) -> DataFrame:
    """(group, cells, done): packed cells by group of grams, and packed repeats that a slice has settled itself."""

    def run(batches):
        for batch in batches:
            rids, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, end, buf, offsets in tk.slices(batch.column(2)):
                row, start, n, lead, gram, content = cells(buf, offsets)
                if not len(row):
                    continue
                got = np.zeros(len(row), _CELL)
                got["content"], got["tag"], got["n"], got["lead"] = content, (gram >> np.uint64(32)).astype(np.uint32), n, lead
                got["start"], got["doc"], got["rid"] = start - offsets[row], ids[at:end][row], rids[at:end][row]
                group = (gram % np.uint64(groups)).astype(np.int64)
                order = np.lexsort((got["start"], got["rid"], got["doc"], got["tag"], content, group))
                got, group = got[order], group[order]
                again = _same_name(got) & np.append(False, group[1:] == group[:-1])
                bounds = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                keys, new, done = group[bounds], [], []
                for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(got)], strict=True):
                    part, old = got[a:b], again[a:b]
                    new.append(_packed(part[~old]))
                    done.append(_packed(part[old]))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(new, pa.binary()), pa.array(done, pa.binary())], names=["grp", "cells", "done"])

    return arrow_map(docs.select("__rid", "__doc", "text"), run, "grp long, cells binary, done binary")


def _packed(part: np.ndarray) -> bytes:
    """Column after column, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(part[f]).tobytes() for f in _CELL.names)


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // _CELL.itemsize
    out, at = np.zeros(n, _CELL), 0
    for f in _CELL.names:
        width = _CELL[f].itemsize * n
        out[f] = np.frombuffer(data[at : at + width], _CELL[f])
        at += width
    return out


def _same_name(got: np.ndarray) -> np.ndarray:
    """Whether each cell has the name of the one before it."""
    out = np.zeros(len(got), bool)
    out[1:] = np.logical_and.reduce([got[f][1:] == got[f][:-1] for f in ("content", "tag", "n", "lead")])
    return out


def _judge(got: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which cells of a group repeat an earlier one of their name, which earliest cells share a gram with another name,
    and which of these with more than `most` names."""
    order = np.lexsort((got["start"], got["rid"], got["doc"], got["tag"], got["content"]))
    repeat = np.zeros(len(got), bool)
    repeat[order] = _same_name(got[order])
    first = np.flatnonzero(~repeat)
    _, which, count = np.unique(got["tag"][first], return_inverse=True, return_counts=True)
    shared, hot = np.zeros(len(got), bool), np.zeros(len(got), bool)
    shared[first[count[which] > 1]] = True
    hot[first[count[which] > most]] = True
    return repeat, shared, hot


def _rows_out(part: np.ndarray, lead: np.ndarray):
    for a in range(0, len(part), 50_000):
        p = part[a : a + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p["rid"]), pa.array(p["start"].astype(np.int64)), pa.array(p["n"].astype(np.int32)), pa.array(lead[a : a + 50_000].astype(np.int32))],
            names=["rid", "start", "n", "lead"],
        )


class _Group:
    """The cells of one group of grams as they come in; what is held stays near HELD_BYTES."""

    def __init__(self):
        self.parts, self.size, self.hot = [], 0, np.zeros(0, np.uint32)

    def take(self, new: bytes, done: bytes):
        if done:
            old = _unpacked(done)
            yield from _rows_out(old, np.full(len(old), -1))
        self.parts.append(_unpacked(new))
        self.size += len(new)
        if self.size >= HELD_BYTES:
            yield from self._settle(False)

    def end(self):
        if self.parts:
            yield from self._settle(True)

    def _settle(self, last: bool):
        """Repeats go out; so do the cells of hot grams, whose strings are all compared later. The other earliest ones
        stay until the group's last."""
        got = np.concatenate(self.parts)
        # a gram found hot before: all its cells are compared string by string, none is left out
        known = np.isin(got["tag"], self.hot)
        yield from _rows_out(got[known], got["lead"][known].astype(np.int64) + _HOT_LEAD)
        got = got[~known]
        repeat, shared, hot = _judge(got, HOT)
        yield from _rows_out(got[repeat], np.full(int(repeat.sum()), -1))
        yield from _rows_out(got[hot], got["lead"][hot].astype(np.int64) + _HOT_LEAD)
        self.hot = np.union1d(self.hot, got["tag"][hot])
        if last:
            rest = shared & ~hot
            yield from _rows_out(got[rest], got["lead"][rest].astype(np.int64))
            return
        kept = got[~repeat & ~hot]
        self.parts, self.size = [kept], kept.nbytes // 2


def _settled(sent: DataFrame, groups: int) -> DataFrame:
    """(rid, start, n, lead): repeats with lead -1, and cells still to be compared with their lead, more by _HOT_LEAD
    where the gram is hot."""

    def run(batches):
        now, group = None, _Group()
        for batch in batches:
            for name, new, old in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name != now:
                    yield from group.end()
                    now, group = name, _Group()
                yield from group.take(new, old)
        yield from group.end()

    dealt = sent.repartition(min(groups, MOST_PARTITIONS), "grp").sortWithinPartitions("grp")
    return arrow_map(dealt, run, "rid long, start long, n int, lead int", 32)


def _cell_parts(texts: DataFrame) -> DataFrame:
    """(place, rid, doc, start, n, data) of the halves of the cells to compare; equal strings share their place."""

    def run(batches):
        half = (WINDOW - GRAM) // 2
        for batch in batches:
            rids, ids, texts_, wanted = (batch.column(c) for c in ("__rid", "__doc", "text", "__cells"))
            out = []
            for rid, doc, text, cells_ in zip(rids.to_pylist(), ids.to_pylist(), strings(texts_).to_pylist(), wanted.to_pylist(), strict=True):
                data = text.encode()
                for c in cells_:
                    start, n, lead = c["start"], c["n"], c["lead"]
                    anchor = start + lead
                    # strings that start at most `half` before the anchor reach `half` beyond its gram
                    split = min(max(anchor - half, start), start + n)
                    for a, b, side in ((start, split, 0), (split, start + n, 1)):
                        if b > a:
                            near = data[anchor - half : anchor + GRAM] if side == 0 else data[anchor : anchor + GRAM + half]
                            out.append((side, near, rid, doc, a, b - a, data[a : b - 1 + WINDOW]))
            for at in range(0, len(out), 10_000):
                side, near, *rest = zip(*out[at : at + 10_000], strict=True)
                sizes = np.cumsum([0, *map(len, near)])
                place = tk.strings_of(np.frombuffer(b"".join(near), np.uint8), sizes[:-1], sizes[1:]).hash ^ np.array(side, np.uint64)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], names=["place", "rid", "doc", "start", "n", "data"])

    return arrow_map(texts, run, "place long, rid long, doc long, start long, n int, data binary", 256)


def _names(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unrelated 64-bit hashes of the WINDOW bytes at each position."""
    hashes = _doubled(np.frombuffer(data, np.uint8))
    quarter, half = hashes[GRAM], hashes[2 * GRAM]
    first = tk.mix(half[at] * np.uint64(_MULTIPLIERS[0]) + half[at + WINDOW - 2 * GRAM])
    second = np.zeros(len(at), np.uint64)
    for k, m in zip((0, GRAM, 2 * GRAM, WINDOW - GRAM), _MULTIPLIERS[1:], strict=False):
        second = tk.mix(second ^ quarter[at + k] * np.uint64(m))
    return first.view(np.int64), second.view(np.int64)


def _hot_matches(texts: DataFrame) -> DataFrame:
    """(rid, start, n): strings with an earlier match among the cells of hot grams.

    Their order is made by the cluster: strings are rows, named by 128 bits of hash, dealt out by ranges of (name,
    position) and sorted. Equal strings then follow each other by position, across ranges too, so a string has a previous
    smaller position with a common prefix of WINDOW if and only if it has the name of the one before it. What stands at
    the edges of ranges, a row or two for each, is compared on the driver.
    """

    def strings(batches):
        for batch in batches:
            held = []
            for rid, doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("__rid", "__doc", "text", "__cells")), strict=True):
                at = np.concatenate([np.arange(c["start"], c["start"] + c["n"]) for c in wanted])
                held.append((*_names(text.encode(), at), np.full(len(at), doc), np.full(len(at), rid), at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=order)

    def compare(batches):
        before, me = None, TaskContext.get().partitionId()
        for batch in batches:
            one, two = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hit = np.zeros(len(one), bool)
            hit[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            hit[0] = before == (one[0], two[0])
            # the first row of a range awaits the last name of the one before
            edge = np.zeros(len(one), np.int32)
            edge[0] = before is None
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), pa.array(hit), batch.column(0), batch.column(1), pa.array(np.full(len(one), me, np.int32)), pa.array(edge)], names=names)
            before = (one[-1], two[-1])
        if before is not None:
            ends = [pa.array([x], pa.int64()) for x in before]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([False]), *ends, pa.array([me], pa.int32()), pa.array([2], pa.int32())], names=names)

    names = ["rid", "start", "hit", "one", "two", "part", "edge"]
    order = ["one", "two", "doc", "rid", "start"]
    rows = arrow_map(texts, strings, "one long, two long, doc long, rid long, start long", 256)
    spark = texts.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    found = arrow_map(ranged.select(*order), compare, "rid long, start long, hit boolean, one long, two long, part int, edge int", 4096)
    found = materialize(found.where("hit OR edge > 0"), "suffix-hot")
    # two rows per range
    edges = found.where("edge > 0").collect()
    heads, tails = {r["part"]: r for r in edges if r["edge"] == 1}, {r["part"]: r for r in edges if r["edge"] == 2}
    parts = sorted(tails)
    more = [(heads[b]["rid"], heads[b]["start"]) for a, b in zip(parts[:-1], parts[1:], strict=True) if (heads[b]["one"], heads[b]["two"]) == (tails[a]["one"], tails[a]["two"])]
    out = found.where("hit").select("rid", "start")
    return out.unionByName(spark.createDataFrame(more, "rid long, start long")).select("rid", "start", F.lit(1).alias("n"))


def earlier_matches(data: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether the window-byte string at each position of `at` (ascending) also stands at an earlier one of them.

    Suffix order by refinement: groups of equal prefixes are split by their next eight bytes until the window is
    read; groups of one are dropped as their neighbours share less than a window with them. What remains are the runs
    of suffix order with common prefixes of a window or more, in which running minima from the left and from the
    right give the previous and the next smaller position.
    """
    n = len(at)
    out = np.zeros(n, bool)
    order, group = np.arange(n), np.zeros(n, np.int64)
    for depth in range(0, window, 8):
        width = min(8, window - depth)
        word = np.zeros(len(order), np.uint64)
        for k in range(width):
            word = word << np.uint64(8) | data[at[order] + depth + k]
        by = np.lexsort((order, word, group))
        order, group, word = order[by], group[by], word[by]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        run = np.cumsum(new) - 1
        keep = np.bincount(run, minlength=1)[run] > 1 if len(run) else new
        order, group = order[keep], run[keep]
        if not len(order):
            return out
    big = np.int64(n + 1)
    run = np.unique(group, return_inverse=True)[1].astype(np.int64)
    left = np.minimum.accumulate(order - run * big) + run * big
    back = run.max() - run
    right = np.minimum.accumulate((order - back * big)[::-1])[::-1] + back * big
    out[order] = (left < order) | (right < order)
    return out


def _compared(parts: DataFrame) -> DataFrame:
    """(rid, start, n): runs of strings with an earlier match among the parts of their place."""

    def judge(rows: list[tuple]):
        rows.sort(key=lambda r: (r[2], r[1], r[3]))
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        sizes = np.array([len(r[5]) for r in rows])
        count = np.array([r[4] for r in rows])
        first = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(rows)), count)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        hit = earlier_matches(data, first[own] + inner)
        edge = np.ones(len(hit), bool)
        edge[1:] = (hit[1:] != hit[:-1]) | (own[1:] != own[:-1])
        a = np.flatnonzero(edge)
        b = np.append(a[1:], len(hit))
        a, b = a[hit[a]], b[hit[a]]
        if len(a):
            rid = np.array([r[1] for r in rows], np.int64)[own[a]]
            start = np.array([r[3] for r in rows], np.int64)[own[a]] + inner[a]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start), pa.array((b - a).astype(np.int32))], names=["rid", "start", "n"])

    def run(batches):
        held, size, now = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != now:
                    if size >= ORDER_BYTES:
                        yield from judge(held)
                        held, size = [], 0
                    now = row[0]
                held.append(row)
                size += len(row[5])
        if held:
            yield from judge(held)

    dealt = parts.repartition("place").sortWithinPartitions("place")
    return arrow_map(dealt.select("place", "rid", "doc", "start", "n", "data"), run, "rid long, start long, n int", 4096)


def _spans(ranges: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that strings [start, start + n) cover."""
    if not ranges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.array([r["start"] for r in ranges], np.int64)
    end = start + np.array([r["n"] for r in ranges], np.int64) - 1 + WINDOW
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(end)) - 1]


def remove_repeats(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """The rows of docs with kept (the bytes that stay), n_bytes, n_removed and spans (removed [start, end)); or, as
    text, the rows with their texts cut at character boundaries and n_chars following them."""

    def cut(batches):
        for batch in batches:
            kept, sizes, gone, spans = [], [], [], []
            texts = batch.column("text").to_pylist()
            for text, ranges in zip(texts, batch.column("__ranges").to_pylist(), strict=True):
                if as_text and not ranges:
                    kept.append(text)
                    continue
                data = (text or "").encode()
                pairs = list(zip(*(x.tolist() for x in _spans(ranges)), strict=True))
                last, parts = 0, []
                for a, b in pairs:
                    if as_text:
                        a, b = _whole_characters(data, a, b)
                    parts.append(data[last:a])
                    last = b
                parts.append(data[last:])
                kept.append(b"".join(parts).decode() if as_text else b"".join(parts))
                sizes.append(len(data))
                gone.append(len(data) - len(kept[-1]))
                spans.append([{"start": a, "end": b} for a, b in pairs])
            if as_text:
                new = {"text": pa.array(kept, pa.string())}
                if "n_chars" in columns:
                    counts = zip(batch.column("n_chars").to_pylist(), kept, batch.column("__ranges").to_pylist(), strict=True)
                    new["n_chars"] = pa.array([len(t) if r and t is not None else n for n, t, r in counts], batch.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], names=columns)
                continue
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [batch.column(c) for c in columns] + [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "kept", "n_bytes", "n_removed", "spans"])

    columns = docs.columns
    docs = _repeatable(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(4, -(-total // GROUP_BYTES))  # of grams; they share at most MOST_PARTITIONS partitions
    numbered = _numbered(docs)
    settled = materialize(_settled(_sent_cells(numbered, groups), groups), "suffix-settled")

    # both joins take the same columns of the same exchange, so the texts are dealt out once
    texts = numbered.repartition("__rid")
    whole = texts.columns

    def asked(which: str) -> DataFrame:
        cells_ = settled.where(which).groupBy(F.col("rid").alias("__rid")).agg(F.collect_list(F.struct("start", "n", "lead")).alias("__cells"))
        return texts.join(cells_, "__rid").select(*whole, "__cells")

    found = settled.where("lead < 0").select("rid", "start", "n").unionByName(_compared(_cell_parts(asked(f"lead >= 0 AND lead < {_HOT_LEAD}"))))
    hot = settled.where(f"lead >= {_HOT_LEAD}").groupBy(F.col("rid").alias("__rid")).agg(F.collect_list(F.struct("start", "n")).alias("__cells"))
    hot = materialize(hot, "suffix-hot-cells")
    count = hot.agg(F.sum(F.size("__cells"))).first()[0]
    if count:
        # the texts are not dealt out once more for a few cells
        found = found.unionByName(_hot_matches(numbered.join(small(hot, count, 48), "__rid").select(*whole, "__cells")))
    ranges = found.groupBy(F.col("rid").alias("__rid")).agg(F.collect_list(F.struct("start", "n")).alias("__ranges"))
    joined = texts.join(ranges, "__rid", "left").select(*whole, "__ranges")
    if as_text:
        return arrow_map(joined, cut, docs.schema, 256)
    schema = StructType([*docs.schema.fields]).add("kept", "binary").add("n_bytes", "long").add("n_removed", "long")
    return arrow_map(joined, cut, schema.add("spans", ArrayType(StructType().add("start", "long").add("end", "long"))), 256)


def _whole_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of [a, b) that holds whole UTF-8 characters."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated strings cut from their texts; one Python stage per task, as for the bytes."""
    return remove_repeats(docs, as_text=True)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
