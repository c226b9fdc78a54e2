import random

import numpy as np
from helpers import SF, awkward, documents
from tokenizers import Tokenizer

from stratum.llm import transducer as tr
from stratum.llm.common import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def truth(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tr.op5_token_counts(spark, SF).collect()}
    assert got == {r.doc_id: (len(r.text.encode()), truth(r.text), truth(r.text) > 1024) for r in docs.collect()}


def test_random_texts_and_splits():
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "'S", "a", "the", "é", "ß", "9", "٣", "½", "!", "...", " ", "　", "\u0085", "漢", "🙂", "<|endoftext|>", "́", "\x1c", "​", "'v", "'t", "ᄀ", "�"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(200)) for _ in range(200)]
    got = tr.TokenCounter(PATH).count(texts)
    for text, n in zip(texts, got, strict=True):
        assert n == truth(text), repr(text)


def test_chunk_maps_give_the_run_of_one_machine():
    rng = np.random.default_rng(5)
    for n in (1, 63, 64, 65, 1000, 5000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        symbols[0] += 8
        if n > 500:
            symbols[200:400] = tr._SHORT2  # no constant map in this stretch
        state, want = 0, []
        for s in symbols:
            want.append(tr.EMIT[s, state])
            state = tr.STEP[s, state]
        assert tr.starts_of(symbols).tolist() == want


def test_random_words_count_right():
    rng = random.Random(4)
    spec = tr.TokenCounter(PATH)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 25))) for _ in range(5000)] + ["a" * 3000, "=" * 500, "ab" * 700]
    for w in words:
        assert spec.counter.count(w.encode()) == truth(w)


def test_awkward_rows(spark, monkeypatch):
    texts = awkward() + ["word " * 400, "x" * 3000 + " y z " * 300]
    docs = documents(spark, texts).selectExpr("*", "1 as n_tokens", "2 as n_bytes")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tr.count_tokens(docs, PATH).collect()}
    assert got == {i: (len((t or "").encode()), truth(t)) for i, t in enumerate(texts)}
    assert tr.count_tokens(docs.limit(0), PATH).count() == 0
    assert "".join(tr.cut_long("one two, three  four five " * 50, 100)) == "one two, three  four five " * 50
    monkeypatch.setattr(tr, "MOST_TRANSITIONS", 10)
    monkeypatch.setattr(tr, "MOST_WORDS", 10)
    small = tr.TokenCounter(PATH)
    for t in texts:
        assert small.count([t or ""])[0] == truth(t)
