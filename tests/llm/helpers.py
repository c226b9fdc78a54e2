"""Fixtures that several operator tests share."""

SF = "/root/testdata/sf0.001"


def documents(spark, texts, sources=None, ids=None, langs=None):
    rows = [
        (i if ids is None else ids[i], t, "en" if langs is None else langs[i], "h" if sources is None else sources[i], None if t is None else len(t))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def save(df, path, name):
    df.write.mode("overwrite").parquet(f"file://{path}/{name}.parquet")
    return f"file://{path}"


def awkward():
    """Texts that break careless code."""
    return [
        None, "", " ", "\n\n", "a", "word", "é" * 50, "naïve café — ½ x² 漢字 かな 🙂 ok", "x" * 5000, "ab " * 900,
        "<|endoftext|> a<|endoftext|>b", "</s>[INST] ok [/INST]", "tab\tand\r\nreturns and wide  spaces ", "it's we're I'll 'tis 'S 123,456.78 $$$",
        "Tail with spaces   ", "same text", "same text", "zero\u0000byte", "The quick brown fox jumps over the lazy dog. " * 6,
    ]


