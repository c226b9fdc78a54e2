import random
import re
from collections import Counter

import numpy as np
from helpers import SF, awkward, documents

from stratum.llm import neardup as nd
from stratum.llm import shingles as sh
from stratum.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text, width=5):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def similarity(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a[x] / a[d], b[x] / b[d]) for x in a.keys() | b.keys())
    return total


def brute(rows, threshold=0.8):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, b in enumerate(bags):
        for d in b:
            holders.setdefault(d, []).append(i)
    near = {(x, y) for h in holders.values() for k, x in enumerate(h) for y in h[:k]}
    for x, y in near:
        if find(x) != find(y) and similarity(bags[x], bags[y]) >= threshold - 1e-12:
            parent[max(find(x), find(y))] = min(find(x), find(y))
    least = {}
    for i, (doc, _) in enumerate(rows):
        key = (doc is None, doc or 0)
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((doc, None if least[find(i)][0] else least[find(i)][1]) for i, (doc, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id) for r in df.collect()), key=str)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    assert any(a != b for a, b in want) and got(nd.op8_near_duplicates(spark, SF)) == want


def variants(n, rates, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words, rate = list(base), rng.choice(rates)
        for i in range(len(words)):
            if rng.random() < rate:
                words[i] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_a_spread_group_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    monkeypatch.setattr(nd, "PASSING", 24)
    monkeypatch.setattr(nd, "STAR", 20)
    texts = variants(120, [0.0, 0.01, 0.02, 0.03, 0.04, 0.06], 1) + variants(40, [0.02, 0.03], 2)
    rng = random.Random(9)
    # chains of near copies of near copies
    for _ in range(60):
        words = rng.choice(texts).split()
        words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(nd.classes(documents(spark, texts).repartition(5))) == brute(rows)


def test_awkward_rows_and_keeping_one(spark):
    long = " ".join(f"word{i}" for i in range(80))
    texts = awkward() + [long, long, long.replace("word40 ", ""), long.upper(), "two words", "Two  words", "a a a a a a a a b", "a a a a a a a a a a b"]
    ids = [1000 - i for i in range(len(texts))]
    ids[20] = None
    rows = list(zip(ids, texts, strict=True)) + [(980, texts[20])]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]).selectExpr("*", "1 as rid", "2 as key", "3 as label")
    want = brute(rows)
    assert got(nd.classes(docs)) == want
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len(want) - sum(a != b for a, b in want) - sum(1 for i, n in Counter(want).items() if n > 1 and i[0] == i[1] for _ in range(n - 1))
    assert nd.classes(docs.limit(0)).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    for _ in range(5):
        wa, wb = rng.integers(0, 4, 400), rng.integers(0, 4, 400)
        row = np.concatenate([np.zeros((wa > 0).sum(), int), np.ones((wb > 0).sum(), int)])
        both = np.concatenate([h[wa > 0], h[wb > 0]])
        s = sh.signatures(row, both, np.concatenate([wa[wa > 0], wb[wb > 0]]), 2, 4096)
        a, b = (Counter({int(x): int(n) for x, n in zip(h, w, strict=True) if n}) for w in (wa, wb))
        exact = sh.probability_jaccard(h[wa > 0], wa[wa > 0], h[wb > 0], wb[wb > 0])
        assert abs(exact - similarity(a, b)) < 1e-9
        assert abs((s[0] == s[1]).mean() - exact) < 0.035


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200)] + [(300, 299)]
    got_ = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got_ == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200, 202: 200, 300: 299, 299: 299}
