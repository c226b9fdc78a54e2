import re
from collections import Counter, defaultdict

from helpers import SF, awkward, documents

from stratum.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if runs[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def fold(line):
    return " ".join(re.sub(r"[A-Z]", lambda m: m[0].lower(), re.sub(r"[0-9]", "0", w)) for w in WORD.findall(line))


def verdicts(rows, share, floor, depleted):
    """Brute force over (doc_id, text, host)."""
    holders, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders[host, fold(line)].add(text or "")
    out = []
    for doc, text, host in rows:
        n, *rest = base(text)
        gone = 0
        for line in (text or "").split("\n"):
            key = holders.get((host, fold(line)), ())
            if WORD.search(line) and len(key) > floor and len(key) > share * len(hosts[host]):
                gone += len(WORD.findall(line))
        failed = n < 20 or 100 * rest[3] > 30 * n
        out.append((doc, n, *rest, failed, not failed and not gone > depleted * n))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def test_measures_match_brute_force_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got, _ = quality.judge(docs, 0.02, 2, 0.3)
    got = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert rows(got) == verdicts(plain, 0.02, 2, 0.3)


def name(*numbers):
    return "".join(chr(97 + n % 26) + "zq"[n // 20 % 2] * (1 + n // 20) for n in numbers)


def test_boilerplate_is_removed_and_depleted_documents_go(spark):
    own = ["\n".join("line " + " ".join(name(i, j, k) for k in range(30)) for j in range(3)) for i in range(40)]
    common = "Accept all  COOKIES now " + "please " * 3
    texts = [t + "\n" + common for t in own] + [f"short {name(i)} own words\n" + "\n".join(f"{common} part{x}" for x in "abcdef") for i in range(30)]
    docs = documents(spark, texts)
    got, removed = quality.judge(docs, 0.1, 5, 0.7)
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[i] for i in range(40, 70))
    stripped = {r.doc_id: r.text for r in quality.strip_lines(docs, removed).collect()}
    assert all(stripped[i] == own[i] for i in range(40))
    assert {r.n_chars == len(r.text) for r in quality.strip_lines(docs, removed).collect()} == {True}
    assert stripped[45] == f"short {name(5)} own words"


def test_copies_do_not_make_boilerplate(spark):
    text = "\n".join("only line %d %s" % (j, " ".join(f"t{j}u{k}" for k in range(20))) for j in range(3))
    got, _ = quality.judge(documents(spark, [text] * 200), 0.1, 5, 0.7)
    assert all(r.kept for r in got.collect())


def test_awkward_rows_and_extra_columns(spark):
    texts = awkward()
    docs = documents(spark, texts, [None if i % 3 else "h" for i in range(len(texts))], [None if i == 4 else i for i in range(len(texts))])
    docs = docs.selectExpr("*", "1 as host", "2 as rid", "'x' as line")
    plain = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got, _ = quality.judge(docs, 0.1, 1, 0.5)
    got = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert rows(got) == verdicts(plain, 0.1, 1, 0.5)
    assert quality.judge(docs.limit(0))[0].count() == 0


def test_large_hosts_lose_lines_of_many_documents(spark):
    n = quality.LINE_MOST + 5
    own = [" ".join(name(i, j) for j in range(30)) + f" w{'x' * (i % 60)}y{'z' * (i // 60)}" for i in range(24 * n)]
    texts = [t + "\nShared by a small part of a large host" * (i < n) + "\nShared by fewer still" * (i < quality.LINE_MOST) for i, t in enumerate(own)]
    left = {r.doc_id: r.text for r in quality.keep_good(documents(spark, texts)).collect()}
    assert len(left) == len(texts) and left[n - 1] == own[n - 1] and left[0] == own[0] + "\nShared by fewer still"
    # the query, and its SQL, have the same bound; without it the share alone leaves the line
    assert quality.judge(documents(spark, texts))[1].count() == n
    assert quality.judge(documents(spark, texts), most=None)[1].count() == 0
    import duckdb

    con = duckdb.connect()
    con.register("documents", documents(spark, texts).toPandas())
    want = {d: w for d, w in con.execute(f"SELECT doc_id, removed_words FROM ({quality.OP7_SQL}) q").fetchall()}
    assert {r.doc_id: r.removed_words for r in quality.judge(documents(spark, texts))[0].collect()} == want and sum(want.values()) == 9 * n
