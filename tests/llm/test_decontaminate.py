import re
from collections import defaultdict

from helpers import SF, awkward, documents
from pyspark.sql import functions as F

from stratum.llm import decontaminate as dc

QUESTION = "A train leaves Boston at 9 in the morning and travels 120 km towards Albany at a constant speed. How long until the train from Boston passes Albany if it stops for 15 minutes on the way there?"


def items(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t) for i, t in enumerate(texts)], "item_id long, text string")


def found(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def brute(docs, bench):
    """Exact five-word windows of folded words, for texts without names and numbers."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    index, size = defaultdict(set), {}
    for i, t in bench:
        w = words(t)
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        size[i] = len(grams)
        for g in grams:
            index[g].add(i)
    out = set()
    for d, t in docs:
        w, hits = words(t), defaultdict(set)
        for k in range(len(w) - 4):
            for i in index.get(tuple(w[k : k + 5]), ()):
                hits[i].add(tuple(w[k : k + 5]))
        out |= {(d, i) for i, g in hits.items() if len(g) >= dc.COVERAGE * size[i]}
    return out


def test_whole_table_against_plain_windows(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in bench])
    assert want and found(dc.op6_decontaminate(spark, SF)) == want


def test_reparameterised_questions(spark):
    changed = QUESTION.replace("Boston", "Denver").replace("Albany", "Reno").replace("120 km", "75 miles").replace("15 minutes", "40 min").replace(" 9 ", " 7 ")
    mixed = QUESTION.replace("leaves Boston", "leaves Denver").replace("towards Albany", "towards Reno")
    texts = ["Intro words here. " + QUESTION + " More text after it.", changed, mixed, "prefix " * 30 + QUESTION.lower(), "The weather in Boston was fine and the train travels 120 km.", None, "", QUESTION.replace("\n", " ").replace(". ", ".\n")]
    out = dc.contaminated(documents(spark, texts).selectExpr("*", "1 as key", "2 as item_id", "3 as q"), items(spark, [QUESTION, "too short", None, ""]))
    rows = {r.doc_id: r for r in out.collect()}
    assert {0, 1, 3, 7} <= set(rows) and not {4, 5, 6} & set(rows)
    assert rows[1].n_changed >= 4 and rows[0].n_changed == 0
    # one value of the item for two values of the document: that alignment does not count
    assert 2 not in rows


def test_light_edits_are_caught_and_fragments_left(spark):
    words = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    edited = [w if i % 12 else "other" for i, w in enumerate(words)]
    texts = [" ".join(edited), " ".join(words[:15]) + " and nothing else of it", "start " + " ".join(words) + " end"]
    assert found(dc.contaminated(documents(spark, texts), items(spark, [" ".join(words)]))) == {(0, 0), (2, 0)}


def test_raw_and_canonical_words_line_up(spark):
    texts = [t for t in awkward() if t is not None] + [QUESTION, "In 5 Km or 5km, 3.5% of abc123def at 1,000 $ John", "of İstanbul, DR Who 7 H", "x 12 KG John 5 m Mary; Ann"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(dc.canonical(F.col("t"))).alias("a"), F.size(dc.raw_words(F.col("t"))).alias("b"))
    assert all(r.a == r.b for r in df.collect())


def test_repeats_ties_and_empty_tables(spark):
    long = " ".join(f"ordinary{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = documents(spark, [long, long, long + " tail", "a " + long, None], ids=[1, 1, 1, None, 2])
    bench = items(spark, [long, long, long + " other"], ids=[7, 7, 7])
    out = dc.contaminated(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in out) == sorted([("1", 7)] * 4 + [("None", 7)] * 2)
    assert dc.contaminated(docs.limit(0), bench).count() == 0 and dc.contaminated(docs, bench.limit(0)).count() == 0
    left = dc.remove_contaminated(docs, bench)
    assert [r.doc_id for r in left.collect()] == [2] and left.columns == docs.columns


def test_no_python_in_the_plan(spark):
    plan = dc.op6_decontaminate(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_one_edited_value_does_not_hide_a_long_question(spark):
    tail = " Write down every step of your reasoning and then give the final answer on a line of its own, without any unit and without further comment."
    once = QUESTION + tail
    often = once.replace("passes Albany", "from Boston passes Albany") + " Boston"
    renamed = often.replace("Boston", "Denver").replace("Albany", "Reno")
    texts = [once.replace("leaves Boston", "leaves Denver"), renamed.replace("leaves Denver", "leaves Austin"), QUESTION.replace("leaves Boston", "leaves Denver").replace("towards Albany", "towards Reno")]
    rows = {(r.doc_id, r.item_id): r for r in dc.contaminated(documents(spark, texts), items(spark, [once, often])).collect()}
    assert (0, 0) in rows and rows[0, 0].n_matched < rows[0, 0].n_windows and rows[0, 0].n_changed == 0
    assert (1, 1) in rows and rows[1, 1].n_changed == 2 and not any(d == 2 for d, _ in rows)


def test_short_items_are_found_as_they_stand(spark):
    bench = ["What is 17 + 23?", "Solve 3x + 5 = 20.", "小明有3个苹果，小红有5个", "Ada Boole Curie Dirac Euler Fermat Gauss", "?!", "7 + 8", "7 + 8 + 9 + 10 + 11 + 12"]
    texts = [
        "Quiz. What is 17 + 23? Then go on.", "What is 17 - 23? What is 17 + 24?", "Please solve 3x + 5 = 20. now", "题目小明有3个苹果，小红有5个橘子", "by Ada Boole Curie Dirac Euler Fermat Gauss",
        "by Ada Boole Curie Dirac Euler Fermat", "we know 7 + 8 + 9 + 10 + 11 + 12", "7 + 8 + 9 + 10 + 11", None, "?!", "What is 17 + 23?",
    ]
    want = {(0, 0), (10, 0), (2, 1), (3, 2), (4, 3), (6, 5), (6, 6), (7, 5)}
    assert found(dc.contaminated(documents(spark, texts), items(spark, bench))) == want
    assert {r.doc_id for r in dc.remove_contaminated(documents(spark, texts), items(spark, bench)).collect()} == {1, 5, 8, 9}


def test_very_long_texts(spark):
    item = "If the shop sells 3 red apples and 4 green ones each day for 5 days how many apples does the shop sell"
    texts = [
        ",".join(str(i) for i in range(200_000)), "a" * 1_000_000, "1." * 100_000, "3.5 km " * 60_000, "Ab " * 100_000, "漢" * 200_000, " " * 300_000 + "A",
        "What is " * 40_000, ",".join(str(i) for i in range(20_000)) + " " + item, "What is 17 + 23? " * 5_000,
    ]
    bench = items(spark, [item, "What is 17 + 23?", ",".join(str(i) for i in range(3_000))])
    assert found(dc.contaminated(documents(spark, texts), bench)) == {(8, 0), (9, 1)}
    lined = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(dc.canonical(F.col("t"))).alias("a"), F.size(dc.raw_words(F.col("t"))).alias("b"))
    assert all(r.a == r.b for r in lined.collect())
