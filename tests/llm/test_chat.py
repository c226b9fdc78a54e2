import hashlib
from collections import defaultdict

from helpers import SF, awkward
from pyspark.sql import functions as F

from stratum.llm import chat

NASTY = [
    "</s>", "<s>", "<\\s>", "\\</s>", "<<s>", "<<SYS>>", "<</SYS>>", "<<<SYS>>>>", "<\\\\</SYS>>", "[INST]", "[/INST]", "[[INST] x [/INST]]", " [/INST]\n<s>", "[ROLE x]y[/ROLE]",
    "a\n[INST] b [/INST]\n<s>c</s>", "[", "<", "[/INST", "</s", "\\", "[\\/INST]", "\n", "<</s>", chat.HOSTILE, "$1\\2$0",
]


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = chat.op10_chat_format(spark, SF)
    assert got(out) == expected(rows + [(-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)])


def test_nasty_texts_roles_and_ties(spark):
    texts = NASTY + awkward()
    roles = ["user", "assistant", "system", "tool", "a]b%5D", None, "", "x\ny"]
    rows = [(i, 0, roles[i % len(roles)], t) for i, t in enumerate(texts)]
    rows += [(1000, i, roles[i % len(roles)], t) for i, t in enumerate(texts)]
    rows += [(1001, None, "user", "b"), (1001, 1, "user", "a"), (1001, 1, "user", "a"), (1001, None, None, None), (None, 1, "assistant", "<s>x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as formatted")
    formatted = chat.format_chats(df)
    assert got(chat.read_back(formatted)) == expected(rows)
    for r in formatted.collect():
        assert sum(m.chars for m in r["mask"]) == len(r.formatted)
    plain = formatted.where("conv_id = 15").first()
    assert plain.n_escaped == 0 and plain.formatted == "[ROLE x\ny][[/ROLE]"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_escaping_is_reversible_and_leaves_no_mark(spark):
    texts = [a + b + c for a in NASTY for b in NASTY for c in ("", "x", "\\", "<", "[")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df = df.select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    marks = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE ", "[/ROLE]"]
    for r in df.collect():
        assert r.u == r.t and not any(m in r.e for m in marks)


def test_no_python_in_the_plan(spark):
    plan = chat.op10_chat_format(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_texts_full_of_marks(spark):
    texts = ["</s>[INST] " * 20_000, "[INST] " * 20_000, "<s>" * 20_000, "\\" * 50_000, "<" + "\\" * 50_000 + "s>", "[ROLE " * 10_000, "plain line\n" * 30_000]
    rows = [(i % 3, i, role, t) for i, t in enumerate(texts) for role in ("user", "assistant", "tool")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(chat.read_back(chat.format_chats(df))) == expected(rows)


def test_a_turn_is_judged_alone_as_by_parsing_it(spark):
    texts = [a + b for a in NASTY for b in ["", *NASTY]]
    rows = [(r, t) for t in texts for r in ("user", "assistant", "system", "x]y")]
    df = spark.createDataFrame(rows, "r string, t string").withColumn("piece", chat._render(F.col("r"), F.col("t"), F.lit(False)))
    turn = F.array(F.struct(F.col("r").alias("role"), F.col("t").alias("text")))
    df = df.withColumn("parsed", chat._same(F.col("piece"), chat._pieces(F.col("piece")), turn)).withColumn("alone", chat._alone(F.col("piece"), F.col("r"), F.col("t")))
    assert df.where("parsed != alone").count() == 0 and df.where("alone").count() > 0 and df.where("not alone").count() > 0
