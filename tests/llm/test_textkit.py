"""Hashes, the exact store behind them, and batches, on strings that break weaker ones."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratum.llm import common, neardup, packing, quality, tokenstore, transducer
from stratum.llm import textkit as tk
from stratum.llm.common import vocabulary
from stratum.llm.encoding import UnitEncoder


def thue_morse(n, a, b):
    """The word whose letters follow the parity of the ones in their places: polynomials modulo 2**64 vanish on it."""
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


PAIRS = [thue_morse(n, *p) for n in (1024, 2048, 4096, 8192) for p in (("a", "b"), ("b", "a"), ("e", "q"), ("q", "e"), ("t", "h"), ("h", "t"), ("i", "n"), ("n", "i"))]


def ids_of(ours, texts):
    _, _, buf, offsets = next(tk.slices(pa.array(texts), 1 << 30))
    flat, sizes = ours.encode(buf, offsets)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


@pytest.fixture
def weak(monkeypatch):
    """A hash of two bits, so that nearly all strings collide."""
    sums = tk._sums
    monkeypatch.setattr(tk, "_sums", lambda *a: sums(*a) & np.uint64(3))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_structured_words_give_the_ids_of_the_library(name):
    library = Tokenizer.from_file(vocabulary(name))
    want = [library.encode(t, add_special_tokens=False).ids for t in PAIRS]
    assert ids_of(UnitEncoder(vocabulary(name)), PAIRS) == want
    if name.startswith("byte"):
        assert transducer.TokenCounter(vocabulary(name)).count(PAIRS).tolist() == [len(w) for w in want]


def test_a_colliding_hash_changes_nothing(weak):
    path = vocabulary("byte_bpe_50k.json")
    library, ours, counter = Tokenizer.from_file(path), UnitEncoder(path), transducer.TokenCounter(path)
    for texts in (["one"], ["two"], ["one two three", "four five", "", "one"], ["six <|endoftext|> seven"]):
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids_of(ours, texts) == want and counter.count(texts).tolist() == [len(w) for w in want]
    _, _, buf, offsets = next(tk.slices(pa.array(["a\nb\na\nc\na b\nb", "a\nd"])))
    assert quality.measure(buf, offsets)["n_dup_lines"].tolist() == [2, 0]


def test_structured_lines_and_documents_stay_apart(spark):
    x, y = thue_morse(2048, "x", "y"), thue_morse(2048, "y", "x")
    _, _, buf, offsets = next(tk.slices(pa.array([x + "\n" + y, y + "\n" + y])))
    assert quality.measure(buf, offsets)["n_dup_lines"].tolist() == [0, 1]
    words = [" ".join(x), " ".join(y), " ".join(x).upper()]
    drawn = neardup.sketch(documents(spark, words)).orderBy("doc_id").collect()
    assert drawn[0].words != drawn[1].words and drawn[0].words2 != drawn[1].words2 and drawn[0].words == drawn[2].words
    # the two hold the same runs of five words about as often, so they are near duplicates, not copies
    assert {r.class_id for r in neardup.classes(documents(spark, [x, y]), 0.8).collect()} == {0, 1}


def test_strings_are_told_by_all_their_bytes():
    rng = np.random.default_rng(1)
    texts = sorted({bytes(rng.integers(97, 99, n).tolist()) for n in range(40) for _ in range(30)})
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    held = tk.strings_of(buf, starts, ends)
    assert len(set(held.hash.tolist())) == len(texts)
    n = np.arange(len(texts))
    assert held.equal(n, held, n).all() and not held.equal(n[:-1], held, n[1:]).any()
    again = tk.strings_of(np.concatenate([buf[:3], buf]), starts + 3, ends + 3)
    assert (again.hash == held.hash).all()


def test_batches_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(common, "BATCH_BYTES", 10_000)
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (20_000 if i == 50 else 10) for i in range(100)])], names=["t"])
    cut = list(common.parts(batch, 30))
    assert sum(p.num_rows for p in cut) == 100 and max(p.num_rows for p in cut) <= 30
    assert [r for p in cut for r in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    packing.pack(documents(spark, ["a", None]), vocabulary("byte_bpe_50k.json")).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_work_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.work_dir(Session())


def test_merkle_roots_by_levels():
    import hashlib

    for n in range(20):
        leaves = [bytes([i]) for i in range(n)]
        level = [hashlib.sha256(b"\0" + d).digest() for d in leaves] or [hashlib.sha256(b"").digest()]
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert tokenstore.merkle(leaves) == level[0]


def test_long_and_structured_texts_pack_and_count(spark):
    texts = [PAIRS[3] + " " + PAIRS[2], "word " * 60_000, "x" * 300_000, ",".join(str(i) for i in range(40_000)), "\n" * 100_000]
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    docs = documents(spark, texts)
    assert {r.doc_id: r.n_tokens for r in transducer.count_tokens(docs, vocabulary("byte_bpe_50k.json")).collect()} == want
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n - 1 for r in got} == want


def test_known_strings_that_are_kept_are_numbered_anew():
    def held(texts):
        data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        return tk.distinct(tk.strings_of(np.frombuffer(data, np.uint8), ends - [len(t) for t in texts], ends))

    texts = [b"a" * n + b"b" * (n % 3) for n in range(1, 60)]
    known, some = tk.Known(), held(texts + texts[::-1])
    assert len(some.keys) == len(texts) and (np.diff(some.keys.astype(object)) > 0).all()
    known.add(some, np.arange(len(some.keys)))
    kept = np.arange(len(texts)) % 4 == 1
    known.keep(kept)
    slot = known.find(some)
    assert slot.tolist() == np.where(kept, np.cumsum(kept) - 1, -1).tolist()
    new = np.flatnonzero(slot < 0)
    known.add(some, new)
    assert sorted(known.find(some).tolist()) == list(range(len(texts))) and (known.find(some)[new] == kept.sum() + np.arange(len(new))).all()
