"""The pipeline against brute force, stage by stage on what the one before kept."""

import zlib

import numpy as np
from helpers import SF, awkward, documents, save
from test_decontaminate import brute as leaks
from test_neardup import brute as classes
from test_quality import verdicts
from tokenizers import Tokenizer

import corpus_pipeline
from stratum.llm import quality
from stratum.llm.common import materialize, vocabulary
from stratum.llm.suffix import WINDOW


def cut(rows):
    """Texts without strings of WINDOW bytes that start earlier, at character boundaries."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - WINDOW + 1):
            s = data[p : p + WINDOW]
            if s in seen:
                gone[p : p + WINDOW] = b"\1" * WINDOW
            seen.add(s)
        kept, at = [], 0
        for c in text:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out[doc] = "".join(kept)
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-pipeline")
        frames.append(docs)
        assert name == "packing" or docs.columns == columns
    rows = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good = {v[0] for v in verdicts([(r.doc_id, r.text, r.source) for r in source], quality.LINE_SHARE, quality.LINE_FLOOR, quality.DEPLETED_SHARE) if v[-1]}
    assert set(rows[0]) == good and good
    assert set(rows[1]) == {a for a, b in classes(list(rows[0].items())) if a == b} and len(rows[1]) < len(rows[0])
    assert all(rows[0][k] == t for k, t in rows[1].items())
    assert rows[2] == cut(rows[1].items()) and rows[2] != rows[1]
    dirty = {d for d, _ in leaks(rows[2].items(), bench)}
    assert rows[3] == {k: t for k, t in rows[2].items() if k not in dirty}
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces = {}
    for r in frames[-1].collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(rows[3])
    for doc, mine in pieces.items():
        ids, at = library.encode(rows[3][doc], add_special_tokens=False).ids + [1], 0
        for r in sorted(mine, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-pipeline")
    assert docs.count() == 0


def test_awkward_rows_pass_all_stages(spark, tmp_path):
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in ("ora", "elt", "inu", "osk")]
    text = lambda k, n=60: " ".join(words[(i * i + 7 * k * i + k) % len(words)] + "xyz"[(i * k) % 3] * (1 + (i + k) % 3) for i in range(n))
    long = " ".join("w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(30_000))
    item = text(3)
    texts = awkward() + [text(1), text(1), text(1), text(2) + " " + item, text(4), text(5) + "\n" + text(4, 40), None, long, ",".join(map(str, range(20_000)))]
    n = len(awkward())
    ids = [*range(n), 100, 100, 101, 102, None, 103, None, 104, 105]
    hosts = ["h"] * n + [None, None, "g", None, "h", "h", None, "g", "g"]
    docs = documents(spark, texts, sources=hosts, ids=ids)
    for c in ("key", "rid", "host", "words", "n", "label", "hashes", "spans", "kept", "h", "d", "k", "start", "length"):
        docs = docs.withColumn(c, docs.doc_id.cast("string"))
    sf = save(docs, tmp_path, "documents")
    save(spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string"), tmp_path, "benchmark")
    docs, columns, kept = spark.read.parquet(f"{sf}/documents.parquet"), docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "test-pipeline")
        if name != "packing":
            assert docs.columns == columns
            kept.append([(r.doc_id, r.text, r.key) for r in docs.collect()])
            assert all(k == (None if d is None else str(d)) for d, _, k in kept[-1])
    assert sorted(str(d) for d, *_ in kept[0]) == ["100", "100", "101", "102", "103", "104", "None"]
    assert sorted(str(d) for d, *_ in kept[1]) == ["100", "102", "103", "104", "None"] and sorted(map(str, kept[1])) != sorted(map(str, kept[2]))
    assert next(t for d, t, _ in kept[2] if d == 103).startswith(text(5)) and len(next(t for d, t, _ in kept[2] if d == 103)) < len(text(5) + text(4, 40))
    assert sorted(str(d) for d, *_ in kept[3]) == ["100", "103", "104", "None"]
    assert {r.doc_id for r in docs.collect()} == {100, 103, 104, None}
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
    # without benchmark items nothing is dropped for them
    save(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    last = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        last = materialize(stage(spark, last, sf), "test-pipeline")
    assert last.count() == 5
