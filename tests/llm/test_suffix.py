import hashlib
import random

import numpy as np
import pytest
from helpers import SF, awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.llm import suffix as sx


def brute(rows, window=sx.WINDOW):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by a dictionary of all strings; rows in order of doc_id."""
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            s = data[p : p + window]
            if s in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, docs):
    out = sx.remove_repeats(docs)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()), key=str)


def test_whole_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = brute(rows)
    out = sorted((tuple(r) for r in sx.op1_suffix_dedup(spark, SF).collect()), key=str)
    assert sum(w[2] for w in want) > 0 and out == want


@pytest.mark.parametrize("hot", [20_000, 8])
def test_planted_passages_and_edges(spark, monkeypatch, hot):
    monkeypatch.setattr(sx, "HOT", hot)
    monkeypatch.setattr(sx, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(sx, "ORDER_BYTES", 2_000)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(6)] + ["x" * 400, "ab" * 300, "Lorem ipsum dolor sit amet consectetur el"]
    texts = []
    for _ in range(150):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.choice([60, 99, 100, 101, 150, 400])], text(rng.randint(0, 12))]
        texts.append("".join(parts))
    texts += [texts[0], texts[3], "x" * 99, "x" * 100, "x" * 101, None, ""] + awkward()
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[7] = None
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0]))
    docs = documents(spark, texts, ids=ids).repartition(4).selectExpr("*", "1 as rid", "2 as start", "3 as n")
    assert got(spark, docs) == brute(rows)
    assert sx.remove_repeats(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    text = " ".join(f"word{i}" for i in range(60))
    out = sx.remove_repeats(documents(spark, [text] * 4, ids=[3, 3, 3, 3]).coalesce(1)).collect()
    assert sorted(r.n_removed for r in out) == [0] + [len(text)] * 3


def test_texts_stay_text(spark):
    rng = random.Random(4)
    shared = "".join(rng.choice("éàüößñ") for _ in range(240))
    texts = ["à" + shared + "x", "è" + shared + "y", "plain text that is not repeated", None]
    out = {r.doc_id: (r.text, r.n_chars) for r in sx.without_repeats(documents(spark, texts)).collect()}
    assert out[0] == (texts[0], len(texts[0])) and out[3] == (None, None) and out[2][0] == texts[2]
    assert len(out[1][0]) == out[1][1] < 10


def lpf(data: bytes) -> list[int]:
    """Longest previous factors of a short string: for each position the length of the longest match that starts
    earlier, from its neighbours with smaller positions in suffix order."""
    n = len(data)
    order = sorted(range(n), key=lambda i: data[i:])
    before, after, stack = [-1] * n, [-1] * n, []
    for p in order:
        while stack and stack[-1] > p:
            after[stack.pop()] = p
        before[p] = stack[-1] if stack else -1
        stack.append(p)

    def common(a: int, b: int) -> int:
        k = 0
        while a >= 0 and b + k < n and data[a + k] == data[b + k]:
            k += 1
        return k

    return [max(common(before[p], p), common(after[p], p)) for p in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 20))
def test_earlier_matches_are_the_longest_previous_factors(letters, window):
    data = bytes(97 + x for x in letters)
    at = np.arange(max(0, len(data) - window + 1))
    found = sx.earlier_matches(np.frombuffer(data, np.uint8), at, window)
    assert found.tolist() == [x >= window for x in lpf(data)[: len(at)]]


def test_anchors_depend_on_the_string_alone(monkeypatch):
    rng = np.random.default_rng(8)
    # a hash of few values, so that nearly every string holds ties
    monkeypatch.setattr(sx.tk, "mix", lambda h: (h % np.uint64(5)) << np.uint64(62))
    passage = rng.integers(97, 123, 400).astype(np.uint8)

    def anchors(before, after):
        buf = np.concatenate([rng.integers(97, 123, before).astype(np.uint8), passage, rng.integers(97, 123, after).astype(np.uint8)])
        _, start, n, lead, *_ = sx.cells(buf, np.array([0, len(buf)]))
        place = np.repeat(start + lead, n)
        return (place[before : before + 301] - before).tolist()

    want = anchors(0, 0)
    assert anchors(700, 3) == want and anchors(5, 90_000) == want and anchors((1 << 20) - 350, 200_000) == want


def test_a_group_settles_what_it_holds(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(9))
    core = "".join(word() for _ in range(15))
    texts = ["".join(word() for _ in range(rng.randint(2, 12))) + core + "".join(word() for _ in range(6)) for _ in range(120)]
    texts += texts[:20] + [core + "same tail " * 12] * 3
    want = brute(list(enumerate(texts)))
    for held, hot in ((1, 5), (2_000, 5), (2_000, 20_000), (1 << 26, 5)):
        monkeypatch.setattr(sx, "HELD_BYTES", held)
        monkeypatch.setattr(sx, "HOT", hot)
        monkeypatch.setattr(sx, "GROUP_BYTES", 5_000)
        monkeypatch.setattr(sx, "MOST_PARTITIONS", 3)
        assert got(spark, documents(spark, texts).repartition(6)) == want
