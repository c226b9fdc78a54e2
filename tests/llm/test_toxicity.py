import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, documents

from stratum.llm import textkit as tk
from stratum.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


def corpus(n, seed, noise=0.0):
    rng = random.Random(seed)
    plain = ["the", "of", "and", "house", "river", "walk", "green", "market", "paper", "window"]
    texts, labels = [], []
    for _ in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.2
        if bad:
            # one word is always bad, two only next to each other
            at = rng.randrange(len(words) + 1)
            words[at:at] = [rng.choice(["nasty", "awful"])] if rng.random() < 0.6 else ["go", "away"]
        else:
            words.insert(0, "go")
            words.append("away" if rng.random() < 0.5 else "go")
        texts.append(" ".join(words))
        labels.append(int(bad) if rng.random() >= noise else 1 - int(bad))
    return texts, np.array(labels)


def test_learns_words_and_pairs_and_generalises(spark):
    model = tx.train(*corpus(1200, 1, 0.02))
    texts, labels = corpus(400, 2)
    got = {r.doc_id: r.predicted for r in tx.score(documents(spark, texts), model).collect()}
    assert np.mean([got[i] == y for i, y in enumerate(labels)]) > 0.95


def test_windows_stay_within_their_text():
    rng = np.random.default_rng(0)
    parts = [[rng.normal(size=(9, tx.FILTERS)).astype(np.float32) for _ in range(w)] for w in tx.WIDTHS]
    shifts = [rng.normal(size=tx.FILTERS) for _ in tx.WIDTHS]
    bags = [rng.integers(1, 9, n) for n in (0, 1, 2, 7)]
    got = tx._pooled(parts, shifts, np.concatenate(bags), np.array([len(b) for b in bags]))
    for i, bag in enumerate(bags):
        padded = np.concatenate([bag, [0, 0, 0, 0]])
        want = []
        for tables, shift in zip(parts, shifts, strict=True):
            z = [sum(tables[t][padded[p + t]] for t in range(len(tables))) for p in range(max(1, len(bag)))]
            want.append(np.maximum(np.max(z, 0) + shift, 0))
        assert np.allclose(got[i], np.concatenate(want), atol=1e-5)


def test_language_is_told_from_the_text():
    texts = ["the cat is on the mat", "le chat est sur la table et il", "der Hund ist nicht auf dem Tisch", "el gato no se come las cosas por la", "zzz qqq", ""]
    _, n, buf, offsets = next(tk.slices(pa.array(texts)))
    place, row = tx.words(buf, offsets)
    assert [[*tx._LANGUAGES, "other"][k] for k in tx.languages(place, row, n)] == ["en", "fr", "de", "es", "other", "other"]


def test_degenerate_and_awkward_rows(spark):
    docs = documents(spark, awkward(), langs=[None] * len(awkward())).selectExpr("*", "0.5 as score", "1 as toxic")
    for model in (tx.train([], np.zeros(0)), tx.train(["a", "b"], np.array([1, 1])), tx.train(*corpus(200, 3))):
        rows = tx.score(docs, model).collect()
        assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert tx.score(docs.limit(0), model).count() == 0


def test_sample_leaves_out_held_out_rows(spark):
    long = next(i for i in range(300, 320) if zlib.crc32(str(i).encode()) % 5)
    docs = documents(spark, [f"text {i}" for i in range(300)] + ["x" * 70000, "text 1"], ids=[*range(300), long, 1])
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(320)] + [(1, True), (None, True)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) toxic").unionByName(spark.sql("select 2L doc_id, cast(null as int) toxic"))
    texts, y = tx.sample(docs, labels)
    want = {f"text {i}": int(i % 3 == 0 or i == 1) for i in range(300) if zlib.crc32(str(i).encode()) % 5}
    assert dict(zip(texts, y.astype(int).tolist(), strict=True)) == want | {"x" * 70000: int(long % 3 == 0)}
    # ids without a text take no place, nor do repeated rows
    assert len(texts) == len(want) + 1 and len(tx.sample(docs, labels, 50)[0]) == 50
    # bytes are counted in the same order, and the row that fills them is the last
    some = tx.sample(docs, labels, most_bytes=100)[0]
    assert some == texts[: len(some)] and sum(map(len, some[:-1])) < 100 <= sum(map(len, some))
    assert tx.sample(docs.limit(0), labels)[0] == [] and tx.sample(docs, labels.limit(0))[0] == []


def test_held_out_accuracy(spark):
    out = tx.op4_toxicity(spark, SF)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    base = np.mean([y == 0 for _, y in held])
    assert np.mean([p == y for p, y in held]) >= max(base, 0.93)


@pytest.mark.parametrize("logits,labels,errors", [([0, 1, 2, 3], [0, 0, 1, 1], 0), ([0, 1, 2, 3], [0, 1, 0, 1], 1), ([0, 1], [0, 0], 0), ([0, 1], [1, 1], 0)])
def test_thresholds_make_the_fewest_errors(logits, labels, errors):
    t = tx._threshold(np.array(logits, float), np.array(labels, float))
    assert sum((z >= t) != y for z, y in zip(logits, labels, strict=True)) == errors
