"""Exact and fast use of the tokenizers library over batches: each distinct unit of text is encoded once.

A text is cut where ASCII white space follows anything but white space, and where ASCII letters, digits and marks
(but for apostrophes and bars) meet. No pre-token of the byte-level file spans
such a place, its lookahead stays inside a unit, and the word file drops white space altogether; so the ids of a
text are those of its units in order, and equal units share the library's answer. Units are told apart byte by byte:
a hash finds them, their bytes confirm it, and should two different ones ever have one hash, the library gets the texts
as they are. Special strings hold no white
space and thus stand within one unit, where the library treats them by its default.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from stratum.llm import textkit as tk
from stratum.llm.common import keeps

#: Units held by a process; beyond it those that were not met again are forgotten, or all if that leaves little room.
MOST_UNITS = 500_000
#: Units that the library gets at once.
_BATCH = 8_000


#: ASCII letters, digits and marks; the apostrophe (contractions) and the bar (special strings) are in no class.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'|"]] = 3
#: Files whose steps are these make one pre-token of a run of letters that no other character interrupts.
_WORD_STEPS = (
    r'''Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])''',
    r'''Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])''',
)


def _only_letters(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a unit holds nothing but letters of ASCII and Latin-1 (U+00C0 to U+00FF), which composition leaves alone
    and whose lower case is one letter each."""
    after = np.append(buf[1:], np.uint8(0))
    lead = (buf == 0xC3) & (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
    letter = (_CLASS[buf] == 1) | lead
    letter[1:] |= lead[:-1]
    others = np.concatenate([[0], np.cumsum(~letter)])
    return others[ends] == others[starts]


def _lowered(buf: np.ndarray) -> np.ndarray:
    """A copy with the ASCII letters in lower case."""
    return np.frombuffer(bytearray(buf).lower(), np.uint8)


def _lower_letters(buf: np.ndarray) -> np.ndarray:
    """Units of letters as above, and blanks, in lower case: U+00C0 to U+00DE stand 32 before theirs."""
    out = _lowered(buf)
    lead = np.flatnonzero(buf == 0xC3) + 1
    out[lead] |= np.where(out[lead] <= 0x9E, np.uint8(0x20), np.uint8(0))
    return out


def _unicode_space_ends(buf: np.ndarray) -> np.ndarray:
    """Whether a byte is the last of a white-space character outside ASCII (or a separator control)."""
    out = (buf >= 0x1C) & (buf <= 0x1F)
    n = len(buf)
    if n and int(buf.max()) >= 0xC2:
        two = np.flatnonzero(buf[:-1] == 0xC2)
        out[two[(buf[two + 1] == 0x85) | (buf[two + 1] == 0xA0)] + 1] = True
        three = np.flatnonzero((buf[:-2] >= 0xE1) & (buf[:-2] <= 0xE3))
        a, b, c = buf[three], buf[three + 1], buf[three + 2]
        e2 = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8D) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        out[three[e2 | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE1) & (b == 0xA0) & (c == 0x8E)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))] + 2] = True
    return out


def units(buf: np.ndarray, offsets: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units; without keep_space their leading ASCII white space is left out."""
    kind = _CLASS[buf]
    stop = np.zeros(len(buf), bool)
    stop[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    space = tk.SPACE[buf]
    if not keep_space:
        # places where a unit may start or end: texts, white space and stops
        edge = np.ones(len(buf) + 1, bool)
        edge[1:-1] = space[1:] | space[:-1] | stop[1:]
        edge[offsets] = True
        solid = ~space
        return np.flatnonzero(solid & edge[:-1]), np.flatnonzero(solid & edge[1:]) + 1
    broad = space | _unicode_space_ends(buf)
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = (space[1:] & ~broad[:-1]) | stop[1:]
    cut[offsets[:-1]] = True
    cut[-1] = False
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(buf)) if len(starts) else starts


class UnitEncoder:
    """ids of texts by one tokenizer file; lives as long as its Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        pre = type(self.tokenizer.pre_tokenizer).__name__
        self.keep_space = pre == "ByteLevel"
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = max(special.items(), key=lambda x: x[1])
        normalizer = self.tokenizer.normalizer
        self.folds = normalizer is not None and not self.keep_space and normalizer.normalize_str("AZ") == "az"
        steps = (str(normalizer), str(self.tokenizer.pre_tokenizer))
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Which ids end a pre-token, for files that tell by their suffix; and the file's splitter and model alone, for
        #: units in lower case that hold no special string.
        self.last = None
        if suffix and steps == _WORD_STEPS:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = self.tokenizer.pre_tokenizer
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.known = tk.Known()
        self.starts, self.sizes, self.ids = tk.Column(np.int64), tk.Column(np.int32), tk.Column(np.uint32)
        self.met = tk.Column(bool)

    def _forget(self, room: int) -> bool:
        """Forgets the units that were not met again since the last time; all of them if so many more find no room in
        half of the store. Whether any is left."""
        met = self.met.data[: len(self.known)]
        if not met.any() or int(met.sum()) + room > MOST_UNITS // 2:
            self._clear()
            return False
        self.known.keep(met)
        sizes = self.sizes.data[: len(met)][met].astype(np.int64)
        first = np.cumsum(sizes) - sizes
        ids = self.ids.data[np.repeat(self.starts.data[: len(met)][met] - first, sizes) + np.arange(int(sizes.sum()))]
        self.starts, self.sizes, self.ids, self.met = tk.Column(np.int64), tk.Column(np.int32), tk.Column(np.uint32), tk.Column(bool)
        for column, values in ((self.starts, first), (self.sizes, sizes), (self.ids, ids), (self.met, np.zeros(len(first), bool))):
            column.extend(values)
        return True

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and their numbers for units that hold the separator themselves."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([x for ids in got for x in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

    def _library_joined(self, data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of n units that stand joined by a special string: the library splits there first and gives it one id."""
        ids = np.array(self.tokenizer.encode_batch_fast([data.decode()], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        sizes = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
        if len(sizes) != n:
            raise ValueError("the separator was not kept apart")
        return np.delete(ids, marks), sizes

    def _library_spaced(self, data: bytes, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """ids of n units of letters that stand joined by blanks: each is one pre-token, whose last id has the suffix."""
        text = _lower_letters(np.frombuffer(data, np.uint8)).tobytes().decode()
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != n or ends[-1] != len(ids) - 1:
            return None
        return ids, np.diff(ends, prepend=-1)

    @staticmethod
    def _joined(buf: np.ndarray, a: np.ndarray, b: np.ndarray, mark: np.ndarray) -> bytes:
        """The units with the mark between them."""
        width = b - a + len(mark)
        to = np.cumsum(width) - width
        joined = np.empty(int(width.sum()), np.uint8)
        shift = np.repeat(a - to, b - a)
        place = np.arange(len(shift)) + np.repeat(np.arange(len(a)) * len(mark), b - a)
        joined[place] = buf[place + shift]
        joined[(to + b - a)[:, None] + np.arange(len(mark))] = mark
        return joined[: -len(mark)].tobytes()

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        # the units alone, one after the other
        width = ends - starts
        to = np.cumsum(width)
        buf = buf[np.repeat(starts - to + width, width) + np.arange(int(width.sum()))]
        starts, ends = to - width, to
        mark = np.frombuffer(self.mark.encode(), np.uint8)
        blank = np.frombuffer(b" ", np.uint8)
        letters = _only_letters(buf, starts, ends) if self.last is not None else np.zeros(len(starts), bool)
        for at in range(0, len(starts), _BATCH):
            a, b, plain = starts[at : at + _BATCH], ends[at : at + _BATCH], letters[at : at + _BATCH]
            got = self._library_spaced(self._joined(buf, a[plain], b[plain], blank), int(plain.sum())) if plain.any() else None
            if got is None:
                plain = np.zeros(len(a), bool)
                got = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            a, b = a[~plain], b[~plain]
            if not len(a):
                more = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            else:
                data = self._joined(buf, a, b, mark)
                if data.count(mark.tobytes()) == len(a) - 1:
                    more = self._library_joined(data, len(a))
                else:
                    text = buf.tobytes()
                    more = self._library([text[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            self._store(plain, got, more)

    def _store(self, plain: np.ndarray, got: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> None:
        """Numbers units in their order; the ids of the plain ones stand before those of the others."""
        sizes, first = np.empty(len(plain), np.int64), np.empty(len(plain), np.int64)
        for which, (ids, count) in ((plain, got), (~plain, more)):
            sizes[which], first[which] = count, self.ids.used + np.cumsum(count) - count
            self.ids.extend(ids)
        self.starts.extend(first)
        self.sizes.extend(sizes)
        self.met.extend(np.zeros(len(plain), bool))

    def _folded(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bytes by which units are compared: in lower case if the file folds case, but for units with a bar, which
        may be special strings and those are told by case."""
        if not self.folds:
            return buf
        out = _lowered(buf)
        for i in np.unique(np.searchsorted(starts, np.flatnonzero(buf == 0x7C), "right") - 1).tolist():
            out[starts[i] : ends[i]] = buf[starts[i] : ends[i]]
        return out

    def _plain(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of whole texts, straight from the library."""
        data, ends = buf.tobytes(), offsets.tolist()
        return self._library([data[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)])

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in order, and how many each has."""
        n = len(offsets) - 1
        starts, ends = units(buf, offsets, self.keep_space)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        some = tk.distinct(tk.strings_of(self._folded(buf, starts, ends), starts, ends))
        slot = None if some is None else self.known.find(some)
        if slot is None:
            return self._plain(buf, offsets)
        new, old = np.flatnonzero(slot < 0), np.flatnonzero(slot >= 0)
        self.met.data[slot[old]] = True
        if len(new):
            if len(self.known) + len(new) > MOST_UNITS:
                # units of this batch are among those met; a cleared store has lost them, so all are learnt then
                number = np.cumsum(self.met.data) - 1
                if self._forget(len(new)):
                    slot[old] = number[slot[old]]
                else:
                    new = np.arange(len(slot))
            slot[new] = len(self.known) + np.arange(len(new))
            one = some.one[new]
            self._learn(buf, starts[one], ends[one])
            self.known.add(some, new)
        at = slot[some.which]
        sizes = self.sizes.data[at]
        before = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        pick = np.repeat(self.starts.data[at] - before[:-1], sizes)
        pick += np.arange(len(pick))
        return self.ids.data[pick], np.diff(before[np.searchsorted(starts, offsets)])


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


keeps("encoding", encoder.cache_clear)
