"""Token counts by compiled finite-state transducers.

Two deterministic machines, both annotated with what they emit:

* the splitter reads character classes and emits the starts of pre-tokens. A batch is cut into chunks; the map from
  entry state to exit state of every chunk is computed for all states at once, the maps are composed by a parallel
  prefix scan, and with its entry state known each chunk runs once more to emit;
* the counter reads the bytes of a pre-token and emits token counts. Byte-pair encoding has one right segmentation,
  and a segmentation is right if each two neighbouring tokens are; so a nondeterministic machine that guesses the
  current token and checks it against the one before is unambiguous. It is determinised by subsets, on demand: a
  state holds (token before, node of the token trie, tokens emitted beyond those on the transitions) for every guess
  still alive, a transition emits what all guesses agree on, and the end of a pre-token emits the rest.

Pre-tokens that were met before are told by a hash and confirmed byte by byte. Special strings of the file are split off first and count as one token each, as the library does by default.
Texts longer than SLICE are cut where a letter, one space and a letter stand, which is a pre-token boundary.

Defined cases: a null text is an empty one with no bytes and no tokens; repeated rows each get a row; extra columns
are ignored; an empty table gives no rows. Both machines are caches: past a size they are dropped and compiled anew.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import textkit as tk
from stratum.llm.common import arrow_map, keeps, table, vocabulary

LIMIT = 1024
#: Characters of a chunk, and of a slice of a long text.
CHUNK = 64
SLICE = 1 << 20
MOST_TRANSITIONS = 1_500_000
MOST_WORDS = 500_000

# classes of characters
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
# symbols of the splitter: classes, and what finite lookahead tells about white space and apostrophes
_L, _N, _O, _BLANK_LAST, _GAP_LAST, _GAP, _SHORT2, _SHORT3 = range(8)
# its states; in the last three the rest of a contraction is being read
_FRESH, _IN_L, _IN_N, _IN_O, _JOIN, _IN_GAP, _ONE_MORE, _TWO_MORE = range(8)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission (a pre-token starts here) by symbol and state; symbols 8 to 15 start a text."""
    step, emit = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    runs = {_L: _IN_L, _N: _IN_N, _O: _IN_O}
    for symbol in range(16):
        for state in range(8):
            s, q = symbol % 8, _FRESH if symbol >= 8 else state
            if q in (_ONE_MORE, _TWO_MORE):
                step[symbol, state] = _ONE_MORE if q == _TWO_MORE else _FRESH
                continue
            if s in (_SHORT2, _SHORT3) and q not in (_JOIN, _IN_O):
                # an apostrophe at the start of a pre-token takes its contraction along
                step[symbol, state], emit[symbol, state] = (_ONE_MORE if s == _SHORT2 else _TWO_MORE), True
                continue
            if s in (_SHORT2, _SHORT3):
                s = _O
            if s in runs:
                step[symbol, state] = runs[s]
                emit[symbol, state] = q not in (runs[s], _JOIN)
            elif s == _BLANK_LAST:
                # the last blank of a gap joins what follows
                step[symbol, state], emit[symbol, state] = _JOIN, True
            elif s == _GAP_LAST:
                step[symbol, state], emit[symbol, state] = _FRESH, True
            else:
                step[symbol, state], emit[symbol, state] = _IN_GAP, q != _IN_GAP
    return step, emit


STEP, EMIT = _splitter()


def starts_of(symbols: np.ndarray) -> np.ndarray:
    """Whether each position starts a pre-token, by chunk maps, a prefix scan and a last run."""
    n = len(symbols)
    if not n:
        return np.zeros(0, bool)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, _GAP, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    flat_step, flat_emit = STEP.reshape(-1), EMIT.reshape(-1)
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (chunks, 8)).copy()
    live = np.arange(chunks)
    for k in range(CHUNK):
        got = flat_step[(grid[k, live].astype(np.intp) * 8)[:, None] + maps[live]]
        maps[live] = got
        if k % 8 == 7:
            # a map that has become constant stays so; the rest of its chunk is run once, below
            live = live[(got != got[:, :1]).any(1)]
            if not len(live):
                break
    constant = (maps == maps[:, :1]).all(1)
    constant[live] = False
    entry = np.zeros(chunks, np.uint8)
    if chunks > 1:
        # chunks whose map became constant early are finished from that single state
        exits = _finish(grid, constant)
        maps[constant] = exits[constant][:, None]
        scan, gap = maps.copy(), 1
        while gap < chunks:
            # composed[i] = scan[i] after scan[i - gap]
            scan[gap:] = np.take_along_axis(scan[gap:], scan[:-gap].astype(np.intp), 1)
            gap *= 2
        entry[1:] = scan[:-1, _FRESH]
    out = np.empty((CHUNK, chunks), bool)
    state = entry
    for k in range(CHUNK):
        at = grid[k].astype(np.intp) * 8 + state
        out[k] = flat_emit[at]
        state = flat_step[at]
    return out.T.reshape(-1)[:n]


def _finish(grid: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Exit state of the chosen chunks, which forget their entry state, from any entry state."""
    state = np.zeros(grid.shape[1], np.uint8)
    at = np.flatnonzero(chosen)
    flat_step, run = STEP.reshape(-1), np.zeros(len(at), np.uint8)
    for k in range(len(grid)):
        run = flat_step[grid[k, at].astype(np.intp) * 8 + run]
    state[at] = run
    return state


class Counter:
    """Subset-determinised counting transducer of a byte-level BPE file."""

    def __init__(self, vocab: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.ranks = ranks
        self.children: list[dict[int, int]] = [{}]
        self.word: list[bytes | None] = [None]
        for token in vocab:
            node = 0
            for byte in token:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                node = nxt
            self.word[node] = token
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.names: dict[tuple, int] = {}
        self.rest: list[int] = []
        self.arcs: dict[int, int] = {}
        self._state(((None, 0, 0),))

    def merged(self, data: bytes) -> list[bytes]:
        """Byte-pair merging of a short string, lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fits(self, a: bytes | None, b: bytes) -> bool:
        """Whether b may follow a in a right segmentation."""
        if a is None:
            key = (b"", b)
            if key not in self.pairs:
                self.pairs[key] = self.merged(b) == [b]
        else:
            key = (a, b)
            if key not in self.pairs:
                self.pairs[key] = self.merged(a + b) == [a, b]
        return self.pairs[key]

    def _ending(self, guesses: tuple) -> tuple[bytes, int] | None:
        """Last token and count if the pre-token ended here; one guess at most is right."""
        for before, node, extra in guesses:
            token = self.word[node]
            if token is not None and self.fits(before, token):
                return token, extra + 1
        return None

    def _state(self, guesses: tuple) -> int:
        name = self.names.get(guesses)
        if name is None:
            name = self.names[guesses] = len(self.states)
            self.states.append(guesses)
            end = self._ending(guesses)
            self.rest.append(0 if end is None else end[1])
        return name

    def compile(self, state: int, byte: int) -> int:
        """The transition of a state on a byte: next state and emitted count, packed."""
        guesses = self.states[state]
        out = []
        for before, node, extra in guesses:
            nxt = self.children[node].get(byte)
            if nxt is not None:
                out.append((before, nxt, extra))
        end = self._ending(guesses)
        if end is not None:
            nxt = self.children[0].get(byte)
            if nxt is not None:
                out.append((end[0], nxt, end[1]))
        agreed = min(x[2] for x in out)
        to = self._state(tuple((a, b, c - agreed) for a, b, c in out))
        arc = self.arcs[state << 8 | byte] = to << 8 | agreed
        return arc

    def count(self, data: bytes) -> int:
        """Tokens of one pre-token."""
        arcs, state, total = self.arcs, 0, 0
        for byte in data:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                arc = self.compile(state, byte)
            total += arc & 255
            state = arc >> 8
        return total + self.rest[state]


def _byte_names() -> dict[str, int]:
    """The printable character that byte-level files write for each byte, from its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class TokenCounter:
    """Token counts of texts by one byte-level BPE file; lives as long as its Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        raw = lambda token: bytes(names[c] for c in token)
        added = {x["content"] for x in spec["added_tokens"]}
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.counter = Counter(vocab, {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)})
        self.special = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.classes = np.full(0x110000, 255, np.uint8)
        for code in range(128):
            c = chr(code)
            self.classes[code] = _LETTER if c.isalpha() else _NUMBER if c.isdigit() else _SPACE if c in "\t\n\x0b\x0c\r " else _OTHER
        self._forget()

    def _forget(self) -> None:
        self.known, self.counts = tk.Known(), tk.Column(np.int64)

    def _classify(self, codes: np.ndarray) -> None:
        """Asks the library's own splitter which class a character new to us has."""
        for code in codes.tolist():
            c = chr(code) if not 0xD800 <= code < 0xE000 else "�"
            alone = lambda text: len(self.split(text)) == 1
            self.classes[code] = _LETTER if alone("a" + c) else _NUMBER if alone("1" + c) else _OTHER if alone("!" + c) else _SPACE

    def symbols(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Symbols of the splitter for characters; first marks those that start a text."""
        kinds = self.classes[codes]
        if (kinds == 255).any():
            self._classify(np.unique(codes[kinds == 255]))
            kinds = self.classes[codes]
        n = len(codes)
        ended = np.ones(n, bool)
        ended[:-1] = first[1:]
        out = np.array([_L, _N, _GAP, _O], np.uint8)[kinds]
        last = np.flatnonzero(kinds == _SPACE)
        last = last[~ended[last]]
        last = last[kinds[last + 1] != _SPACE]
        out[last] = np.where(codes[last] == 32, _BLANK_LAST, _GAP_LAST)
        quotes = np.flatnonzero(codes == 39)
        if len(quotes):
            ahead = np.zeros((2, n + 2), np.uint32)
            ahead[0, :n], ahead[1, :n] = np.where(ended, 0, np.append(codes[1:], 0)), 0
            ahead[1, : n - 1] = np.where(ended[:-1], 0, ahead[0, 1:n])
            a, b = ahead[0, quotes], ahead[1, quotes]
            out[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = _SHORT2
            for x, y in ("re", "ve", "ll"):
                out[quotes[(a == ord(x)) & (b == ord(y))]] = _SHORT3
        return out + first.astype(np.uint8) * 8

    def _words(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token counts of the pre-tokens in [start, end)."""
        if len(self.counter.arcs) > MOST_TRANSITIONS:
            self.counter.clear()
        if len(self.counter.pairs) > MOST_TRANSITIONS:
            self.counter.pairs.clear()
        count = self.counter.count
        return np.fromiter((count(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))

    def _pieces(self, texts: list[str]) -> np.ndarray:
        """Token counts of texts without special strings."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        first = np.zeros(len(codes), bool)
        first[(ends - lengths)[lengths > 0]] = True
        marks = np.flatnonzero(starts_of(self.symbols(codes, first)))
        data = joined.encode()
        buf = np.frombuffer(data, np.uint8)
        place = np.flatnonzero((buf & 0xC0) != 0x80)[marks]
        stop = np.append(place[1:], len(buf))
        some = tk.distinct(tk.strings_of(buf, place, stop))
        slot = None if some is None else self.known.find(some)
        if slot is None:
            # two different pre-tokens have one hash: each is counted for itself
            counts = self._words(data, place, stop)
        else:
            new = np.flatnonzero(slot < 0)
            if len(self.known) + len(new) > MOST_WORDS:
                self._forget()
                new = np.arange(len(slot))
            if len(new):
                slot[new] = len(self.known) + np.arange(len(new))
                one = some.one[new]
                self.counts.extend(self._words(data, place[one], stop[one]))
                self.known.add(some, new)
            counts = self.counts.data[slot[some.which]]
        total = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(total[np.searchsorted(marks, np.concatenate([[0], ends]))])

    def count(self, texts: list[str]) -> np.ndarray:
        """Token counts of whole texts."""
        out = np.zeros(len(texts), np.int64)
        pieces, owner, held = [], [], 0

        def flush() -> None:
            nonlocal pieces, owner, held
            np.add.at(out, owner, self._pieces(pieces))
            pieces, owner, held = [], [], 0

        for i, text in enumerate(texts):
            parts = [text]
            if self.special and self.special.search(text):
                out[i] += len(self.special.findall(text))
                parts = self.special.split(text)
            for part in parts:
                for piece in cut_long(part):
                    pieces.append(piece)
                    owner.append(i)
                    held += len(piece)
                    if held >= SLICE:
                        flush()
        if pieces:
            flush()
        return out


_SAFE = re.compile(r"[A-Za-z](?= [A-Za-z])")


def cut_long(text: str, most: int = SLICE):
    """Slices of a text of about `most` characters, cut before a blank between ASCII letters."""
    at = 0
    while len(text) - at > most:
        found = _SAFE.search(text, at + most)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


keeps("transducer", counter.cache_clear)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether they exceed the limit, for every row."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = counter(path).count(texts)
            size = pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", owner="transducer")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
