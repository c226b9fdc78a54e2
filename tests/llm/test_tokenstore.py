import zlib

import numpy as np
import pytest
from helpers import SF, awkward, documents
from tokenizers import Tokenizer

from stratum.llm import tokenstore as ts
from stratum.llm.common import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def expected(rows):
    library = Tokenizer.from_file(PATH)
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(ts.op9_token_store(spark, SF)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_chunks_are_stored_once_and_ids_rebuilt(spark, tmp_path):
    rng = np.random.default_rng(1)
    long = " ".join(f"w{x}" for x in rng.integers(0, 5000, 9000))
    texts = awkward() + [long, long, "new start " + long, long + " end", long[2000:]]
    ids = [(i * 7919) % 1000 for i in range(len(texts))]
    ids[3] = None
    docs = documents(spark, texts, ids=ids).selectExpr("*", "1 as start", "2 as run", "3 as digest").repartition(4)
    folder = f"file://{tmp_path}/store"
    ts.write_store(docs, folder, PATH)
    assert got(ts.read_store(spark, folder)) == expected(list(zip(ids, texts, strict=True)))
    index = spark.read.parquet(f"{folder}/index")
    assert index.count() == index.select("digest").distinct().count()
    stored = sum(r.ids for r in index.collect())
    assert sum(f.stat().st_size for f in (tmp_path / "store/packs").iterdir()) == 2 * stored + 5 * index.select("pack").distinct().count()
    total = sum(r[2] for r in got(ts.read_store(spark, folder)))
    assert stored < total - 3 * 9000
    library = Tokenizer.from_file(PATH)
    back = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in ts.read_ids(spark, folder).collect()}
    assert back == {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in zip(ids, texts, strict=True)}
    starts = [r.doc_id for r in spark.read.parquet(f"{folder}/recipes").orderBy("run", "local_start").collect()]
    assert starts == sorted(starts, key=lambda x: (x is not None, x))

    pack = sorted((tmp_path / "store/packs").iterdir(), key=lambda f: -f.stat().st_size)[0]
    data = bytearray(pack.read_bytes())
    data[50] ^= 1
    pack.write_bytes(data)
    with pytest.raises(Exception, match="damaged chunk"):
        ts.read_store(spark, folder).collect()


def test_empty_table_and_repeated_ids(spark, tmp_path):
    docs = documents(spark, ["a", "b c", "b c"], ids=[5, 5, 5])
    ts.write_store(docs, f"file://{tmp_path}/a", PATH)
    rows = got(ts.read_store(spark, f"file://{tmp_path}/a"))
    assert sorted(r[2] for r in rows) == [2, 3, 3] and len({r[1] for r in rows}) == 3
    ts.write_store(docs.limit(0), f"file://{tmp_path}/b", PATH)
    assert ts.read_store(spark, f"file://{tmp_path}/b").count() == 0


def test_checksums_combine():
    rng = np.random.default_rng(0)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 5000, 20)]
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(20)])
    each = np.array([zlib.crc32(p) for p in parts])
    assert int(np.bitwise_xor.reduce(ts.crc_after(each, after))) == zlib.crc32(b"".join(parts))


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 40000, 30000).astype(np.uint32)
    b = np.concatenate([rng.integers(0, 40000, 777).astype(np.uint32), a])
    one, two = ts.cuts(a, np.array([len(a)]))[0], ts.cuts(b, np.array([len(b)]))[0]
    assert len({x + 777 for x in one} & set(two)) > 0.9 * len(one)
    assert max(np.diff([0, *one])) <= ts.LONGEST and one[-1] == len(a)
    same = np.zeros(10000, np.uint32)
    assert ts.cuts(same, np.array([10000]))[0][-1] == 10000


def test_large_ids_are_cut_as_small_ones_are():
    rng = np.random.default_rng(2)
    small = rng.integers(0, 1 << 16, 20000).astype(np.uint32)
    both = np.concatenate([small, np.array([1 << 20], np.uint32)])
    one, two = ts.cuts(small, np.array([len(small)]))[0], ts.cuts(both, np.array([len(small), 1]))[0]
    assert one == two and len(one) > 20
