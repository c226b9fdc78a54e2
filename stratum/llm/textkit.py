"""Vectorised kernels over batches of UTF-8 texts: words, lines and hashes of byte ranges."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from stratum.llm.common import strings

#: Bytes that numpy temporaries are sized for; a longer text makes a slice of its own.
SLICE_BYTES = (1 << 20) - 1

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240607)
#: One random 64-bit value for each byte.
BYTE_VALUES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)

_SALTS = _rng.integers(0, 1 << 64, 1 << 12, dtype=np.uint64)
#: Masks that keep so many bytes of a block.
_TAILS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@dataclasses.dataclass
class Strings:
    """Byte strings as runs of eight-byte blocks, the last one padded with zeros, and a hash of each string."""

    hash: np.ndarray
    block: np.ndarray
    first: np.ndarray
    count: np.ndarray | None
    length: np.ndarray

    def equal(self, i: np.ndarray, other: Strings, j: np.ndarray) -> np.ndarray:
        """Whether string i[k] here and string j[k] there are the same bytes."""
        same = self.length[i] == other.length[j]
        # most strings are one block long: the first blocks need no ranges
        at = np.flatnonzero(same & (self.length[i] > 0))
        same[at] = self.block[self.first[i[at]]] == other.block[other.first[j[at]]]
        at = np.flatnonzero(same & (self.length[i] > 8))
        count = self.count[i[at]]
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        differ = self.block[np.repeat(self.first[i[at]], count) + inner] != other.block[np.repeat(other.first[j[at]], count) + inner]
        same[np.repeat(at, count)[differ]] = False
        return same


def _sums(block: np.ndarray, first: np.ndarray, count: np.ndarray, length: np.ndarray, inner: np.ndarray, seed: int) -> np.ndarray:
    """Each block is mixed with its place, so a hash is a sum of unrelated numbers; no structure of the string cancels."""
    salt = _SALTS[inner & (len(_SALTS) - 1)] + (inner >> 12).astype(np.uint64) * np.uint64(_ODD)
    out = np.zeros(len(first), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        out[full] = np.add.reduceat(mix((block ^ salt) + np.uint64(seed * 0x632BE59BD9B4E019 & _MASK)), first[full])
    return mix(out + (length.astype(np.uint64) + np.uint64(seed)) * np.uint64(_ODD))


def strings_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Strings:
    """The bytes in each [start, end), with 64-bit hashes: equal strings have equal hashes wherever they stand."""
    length = ends - starts
    count = (length + 7) >> 3
    first = np.cumsum(count) - count
    inner = np.arange(int(count.sum())) - np.repeat(first, count)
    at = np.repeat(starts, count) + 8 * inner
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    block = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))[at]
    block &= _TAILS[np.minimum(np.repeat(ends, count) - at, 8)]
    return Strings(_sums(block, first, count, length, inner, 0), block, first, count, length)


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the values in each [start, end), for ranges in order that do not overlap."""
    count = ends - starts
    first = np.cumsum(count) - count
    inner = np.arange(int(count.sum())) - np.repeat(first, count)
    return _sums(values[np.repeat(starts, count) + inner], first, count, count, inner, seed)


@dataclasses.dataclass
class Distinct:
    """The distinct strings of a batch by ascending hash: one place of each, and which of them every string is."""

    strings: Strings
    keys: np.ndarray
    one: np.ndarray
    which: np.ndarray


def distinct(strings: Strings) -> Distinct | None:
    """Told by hash and confirmed byte by byte; None if two different strings have one hash."""
    coded = pa.array(strings.hash).dictionary_encode()
    keys, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.argsort(keys)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    keys, which = keys[order], place[which]
    one = np.empty(len(keys), np.int64)
    one[which] = np.arange(len(which))
    if not strings.equal(np.arange(len(which)), strings, one[which]).all():
        return None
    return Distinct(strings, keys, one, which)


class Column:
    """An array that grows at its end, by half of what it has."""

    def __init__(self, kind: type):
        self.data, self.used = np.zeros(1 << 12, kind), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.used + len(more)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(need, 3 * self.used // 2) - self.used, self.data.dtype)])
        self.data[self.used : need] = more
        self.used = need


class Known:
    """Strings met before, by hash, with their bytes: numbers them in the order they are added."""

    def __init__(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.block, self.first, self.length = Column(np.uint64), Column(np.int32), Column(np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, some: Distinct) -> np.ndarray | None:
        """The number of each distinct string, -1 where it is new; None if a known string of other bytes has its hash."""
        if not len(self.keys):
            return np.full(len(some.keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, some.keys), len(self.keys) - 1)
        slot = np.where(self.keys[at] == some.keys, self.slots[at].astype(np.int64), -1)
        old = np.flatnonzero(slot >= 0)
        mine = Strings(self.keys, self.block.data, self.first.data, None, self.length.data)
        return slot if some.strings.equal(some.one[old], mine, slot[old]).all() else None

    def add(self, some: Distinct, new: np.ndarray) -> None:
        """Numbers the distinct strings at the places `new`, in this order."""
        source, one = some.strings, some.one[new]
        count = source.count[one]
        first = np.cumsum(count) - count
        inner = np.arange(int(count.sum())) - np.repeat(first, count)
        self.first.extend(self.block.used + first)
        self.block.extend(source.block[np.repeat(source.first[one], count) + inner])
        self.length.extend(source.length[one])
        keys = np.concatenate([self.keys, some.keys[new]])
        slots = np.concatenate([self.slots, (len(self.slots) + np.arange(len(new))).astype(np.int32)])
        # two sorted runs: a stable sort merges them
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], slots[order]

    def keep(self, kept: np.ndarray) -> None:
        """Forgets all strings but those that are marked, by number; these are numbered anew, in their order."""
        mine = np.flatnonzero(kept)
        count = (self.length.data[mine].astype(np.int64) + 7) >> 3
        first = np.cumsum(count) - count
        inner = np.arange(int(count.sum())) - np.repeat(first, count)
        block, length = self.block.data[np.repeat(self.first.data[mine].astype(np.int64), count) + inner], self.length.data[mine]
        self.block, self.first, self.length = Column(np.uint64), Column(np.int32), Column(np.int32)
        for column, values in ((self.block, block), (self.first, first), (self.length, length)):
            column.extend(values)
        stays = kept[self.slots]
        self.keys, self.slots = self.keys[stays], (np.cumsum(kept) - 1)[self.slots[stays]].astype(np.int32)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about `most` bytes."""
    column = strings(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of bytes other than ASCII white space; no word crosses texts."""
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    after = np.empty(len(buf), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each position belongs to."""
    return np.searchsorted(offsets, positions, "right") - 1


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every line; each text has one line more than line feeds."""
    feeds = np.flatnonzero(buf == 10)
    row = rows_of(feeds, offsets)
    n = len(offsets) - 1
    rows = np.concatenate([np.arange(n), row])
    starts = np.concatenate([offsets[:-1], feeds + 1])
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[last] = offsets[1:]
    return rows, starts, ends


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of `width` words of one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(_ODD) + hashes[k : k + n]
    first = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return first, mix(out[first])


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers by row."""
    return np.bincount(rows, values, n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list column from the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
