"""Weighted word shingles and their ProbMinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np

from stratum.llm import textkit as tk

WIDTH = 5
REGISTERS = 96

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def weighted(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, times it occurs) sorted by row and hash, and two unrelated hashes of each row's word sequence.

    Words are runs other than ASCII white space, in ASCII lower case. A text of fewer than `width` words, but one at
    least, has itself as its only shingle; a text without words has none.
    """
    n = len(offsets) - 1
    starts, ends = tk.words(buf, offsets)
    rows = tk.rows_of(starts, offsets)
    words = tk.strings_of(_FOLD[buf], starts, ends).hash
    first, hashes = tk.windows(words, rows, width)
    row = rows[first]
    bounds = np.searchsorted(rows, np.arange(n + 1))
    whole = tk.sequence_hashes(words, bounds[:-1], bounds[1:])
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < width))
    row = np.concatenate([row, short])
    hashes = np.concatenate([hashes, whole[short]])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return row[at], hashes[at], np.diff(np.append(at, len(row))), whole, tk.sequence_hashes(words, bounds[:-1], bounds[1:], 1)


def signatures(row: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of each row: registers[k] names the shingle that arrived there first.

    A shingle of weight w sends points at the times of a Poisson process of rate w, each to a register drawn from the
    shingle's own stream; a register keeps its first. A shingle stops as soon as its next point comes after the last
    register of its row was taken. Two rows agree in a register with the probability Jaccard of their weights.
    """
    best = np.full(n * registers, np.inf)
    name = np.zeros(n * registers, np.uint64)
    row, seed, rate = row.astype(np.int64), hashes, weights.astype(np.float64)
    time = np.zeros(len(row))
    turn = 0
    while len(row):
        turn += 1
        draw = tk.mix(seed + np.uint64(turn * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        place = (tk.mix(draw + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        at = row * registers + place.astype(np.int64)
        np.minimum.at(best, at, time)
        won = best[at] == time
        name[at[won]] = seed[won]
        last = best.reshape(n, registers).max(1) if n else np.zeros(0)
        on = time < last[row]
        row, seed, rate, time = row[on], seed[on], rate[on], time[on]
    return name.reshape(n, registers)


def probability_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets given by sorted hashes and weights."""
    common, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = w1[i].astype(np.float64), w2[j].astype(np.float64)
    only1, only2 = float(w1.sum()) - a.sum(), float(w2.sum()) - b.sum()
    pairs, times = np.unique(np.stack([a, b], 1), axis=0, return_counts=True) if (a != 1).any() or (b != 1).any() else (np.ones((1, 2)), np.array([len(a)]))
    a, b = pairs[:, 0], pairs[:, 1]
    total = np.maximum(a[None, :] / a[:, None], b[None, :] / b[:, None]) @ times
    return float((times / (only1 / a + only2 / b + total)).sum())
