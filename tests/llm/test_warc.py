import gzip
import hashlib

from helpers import SF, awkward
from pyarrow import fs

from stratum.llm import warc


def expected(rows):
    best = {}
    for page, html in rows:
        d = hashlib.sha1((html or "").encode()).hexdigest()
        if page is not None:
            best[d] = max(best.get(d, page), page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        d = hashlib.sha1(data).hexdigest()
        again = len(data) >= 1000 and d in best and (page is None or page < best[d])
        out.append((page, len(data), d, "revisit" if again else "response", best[d] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert got(warc.op3_warc(spark, SF)) == expected([(r.page_id, r.html) for r in pages.collect()])


def test_awkward_rows_copies_and_selection(spark, tmp_path):
    big = "<p>" + "x" * 2000 + "</p>"
    rows = [(i, f"http://h/{i}?q=a b\r\nX: y", t) for i, t in enumerate(awkward())] + [(100 + i, None, big) for i in range(50)]
    rows += [(None, "u", big), (149, "again", big), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as refers_to", "3 as __page").repartition(5)
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(pages, folder)
    records = warc.read_records(index, folder)
    assert got(records) == expected([(a, c) for a, _, c in rows])
    some = warc.read_records(index.where("page_id in (3, 149)"), folder)
    assert sorted(r.page_id for r in some.collect()) == [3, 149, 149]
    texts = {r.page_id: bytes(r.payload).decode() for r in records.where("record_type = 'response' and page_id < 100").collect()}
    assert texts == {i: t or "" for i, _, t in rows if i is not None and i < 100}
    file = index.first().file
    with fs.LocalFileSystem().open_input_stream(f"{tmp_path}/warc/{file}", compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\n")
    assert warc.write_archives(pages.limit(0), folder).count() == 0


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 200, 10), ("b", 0, 5)]
    assert warc.ranges(rows, gap=50, most=1000) == [("a", 0, 20, [0, 1]), ("a", 200, 10, [2]), ("b", 0, 5, [3])]
    assert len(warc.ranges(rows, gap=500, most=15)) == 4
