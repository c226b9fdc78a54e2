"""Benchmark decontamination by template canonicalisation, on DataFrame functions only.

Numbers, units after numbers and capitalised words inside sentences become typed placeholders; the other words are
folded to lower case. Windows of WINDOW canonical words are hashed and joined with those of the benchmark, so a
question whose figures or names were changed still matches. Where windows of a document and an item line up, the
values in their slots must correspond: a value of the item may stand for one value only. Where it meets several, the
windows that hold another than the commonest are dropped; without a commonest one the alignment does not count. A
document is contaminated by an item if consistent windows cover at least COVERAGE of the item's, or if windows whose raw
words equal the item's, of any alignment, cover at least VERBATIM of them.

An item without a window that counts (fewer than WINDOW words, or fewer than LITERALS ordinary ones in each) is found
where its whole sequence of tokens stands in a document: words, numbers, signs of arithmetic and single characters of
scripts without spaces, folded to lower case. It counts as one window. Items that hold such characters are looked for
in this way too, as their words run into those around them.

Defined cases: a null text is an empty one; an item without a letter or digit matches nothing, one of a single word
every document that holds it; repeated rows (same id and text) count as one document, rows that
share only the id are judged apart and give a row each; repeated item ids are items of their own if their texts
differ; extra columns are ignored; an empty table, on either side, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import materialize, small, table

WINDOW = 5
#: Ordinary words that a benchmark window needs to be looked for.
LITERALS = 3
COVERAGE = 0.4
#: Share of windows equal word for word that tells a leak though values conflict: above that of the question with two
#: of its names edited in one place each, which test_reparameterised_questions defines as no leak.
VERBATIM = 0.8

#: Units of measure and money that may follow a number.
UNITS = (
    "km m cm mm mi mile miles ft feet foot inch inches yd yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kph kmh hz khz mhz ghz w kw kwh v a kb mb gb tb "
    "dollar dollars usd euro euros eur cent cents percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres kilogram kilograms gram grams"
).split()

#: Private characters that stand for the slots.
_NAME, _NUMBER, _UNIT = "\ue000", "\ue001", "\ue002"
_PRIVATE = "[\ue000-\ue002]"
# possessive, as a greedy group of such a body recurses once for each repetition; nothing after it wants a digit back
_NUMBERS = r"\p{N}++(?:[.,]\p{N}++)*+"
# a number is tried from its start only: its tails end where it ends, and trying them all would read it once a digit
_MEASURES = rf"(?<!\p{{N}})(?<!\p{{N}}[.,]){_NUMBERS}\s?(?:(?:{'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?![\p{{L}}\p{{M}}])|[%€$£])"
#: A capitalised word after a word, a number, a comma or a semicolon; the capital is looked for first, as it is rarer.
_NAMES = rf"(?=\p{{Lu}})(?<=[\p{{L}}\p{{M}},;{_NUMBER}{_UNIT}]\s{{1,3}})\p{{Lu}}[\p{{L}}\p{{M}}]*"
_RAW = rf"(?i){_MEASURES}|{_NUMBERS}|[\p{{L}}\p{{M}}]+"
#: Tokens of items that have no window: characters of scripts without spaces are tokens of their own.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_TOKENS = rf"{_NUMBERS}|[{_UNSPACED}]\p{{M}}*|[\p{{L}}\p{{M}}&&[^{_UNSPACED}]]+|[\p{{Sm}}*/^÷%-]"
_CANON = rf"{_NUMBER}{_UNIT}|[{_NAME}{_NUMBER}]|[\p{{L}}\p{{M}}]+"


def _clean(text: Column) -> Column:
    own = F.contains(text, F.lit(_NAME)) | F.contains(text, F.lit(_NUMBER)) | F.contains(text, F.lit(_UNIT))
    return F.when(own, F.regexp_replace(text, F.lit(_PRIVATE), F.lit(" "))).otherwise(text)


def canonical(text: Column) -> Column:
    """Canonical words: folded words and placeholders."""
    clean = _clean(text)
    measures = F.regexp_replace(clean, F.lit("(?i)" + _MEASURES), F.lit(f" {_NUMBER}{_UNIT} "))
    numbers = F.regexp_replace(measures, F.lit(_NUMBERS), F.lit(f" {_NUMBER} "))
    # most texts hold no digit: one look for one is cheaper than two rewritings
    plain = F.when(clean.rlike(r"\p{N}"), numbers).otherwise(clean)
    names = F.regexp_replace(plain, F.lit(_NAMES), F.lit(_NAME))
    return F.regexp_extract_all(F.lower(names), F.lit(_CANON), F.lit(0))


def raw_words(text: Column) -> Column:
    """The same words as they stand, position by position."""
    return F.regexp_extract_all(_clean(text), F.lit(_RAW), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(_clean(text)), F.lit(_TOKENS), F.lit(0))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: bound as the variable of a one-element transform."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_of(words: Column, first: Column, length: int) -> Column:
    """`length` words from place `first` on, each taken by its place: a slice would unpack the whole array every time."""
    return F.array(*[F.get(words, first + k) for k in range(length)])


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    """64-bit hash of every run of `width` words."""

    def runs(h: Column) -> Column:
        last = F.size(h) - width
        hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item (hash of its text), q (position), n (windows that count), hash, raw words and slots of each window."""
    text = F.coalesce(F.col("text"), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).distinct()
    items = items.select("item_id", F.xxhash64("text").alias("item"), canonical(F.col("text")).alias("canon"), raw_words(F.col("text")).alias("raw"))
    slots = F.transform("canon", lambda w: F.startswith(w, F.lit(_NAME)) | F.startswith(w, F.lit(_NUMBER)))
    items = items.withColumn("slots", slots).withColumn("hashes", window_hashes(F.col("canon")))
    spot = lambda h, q: F.struct(q.alias("q"), h.alias("hash"), run_of(F.col("raw"), q, WINDOW).alias("item_raw"), run_of(F.col("slots"), q, WINDOW).alias("slots"))
    rows = items.select("item_id", "item", F.explode(F.transform("hashes", spot)).alias("x")).select("item_id", "item", "x.*")
    rows = rows.where(F.size(F.filter("slots", lambda s: ~s)) >= LITERALS)
    n = rows.groupBy("item_id", "item").agg(F.countDistinct("hash").alias("n"))
    return rows.join(n, ["item_id", "item"])


def short_items(benchmark: DataFrame) -> DataFrame:
    """item_id, item, length, whole (hash of all tokens), width and anchor (hash of the first tokens, WINDOW at most) of
    the items that have no window in benchmark_windows or hold characters of scripts without spaces."""
    text = F.coalesce(F.col("text"), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).distinct()
    items = items.select("item_id", F.xxhash64("text").alias("item"), canonical(F.col("text")).alias("canon"), tokens(F.col("text")).alias("tokens"))
    ordinary = F.transform("canon", lambda w: ~F.startswith(w, F.lit(_NAME)) & ~F.startswith(w, F.lit(_NUMBER)))
    items = items.withColumn("ordinary", ordinary)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("canon") - WINDOW, F.lit(0))), lambda q: F.size(F.filter(run_of(F.col("ordinary"), q, WINDOW), lambda o: o)) >= LITERALS)
    unspaced = F.exists("tokens", lambda t: t.rlike(f"[{_UNSPACED}]"))
    items = items.where((F.size("canon") > 0) & ((F.size("canon") < WINDOW) | (F.size(starts) == 0) | unspaced))
    items = items.withColumn("length", F.size("tokens")).withColumn("width", F.least(F.col("length"), F.lit(WINDOW)))
    return items.select("item_id", "item", "length", F.xxhash64("tokens").alias("whole"), "width", F.xxhash64(F.slice("tokens", F.lit(1), F.col("width"))).alias("anchor"))


def _verbatim(documents: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """(doc_id, key, item_id, item) of the documents that hold a short item as it stands; None if there is no such item.

    Anchors find the places where an item may start; there, one hash for each length of the items that start so is
    joined with the hashes of whole items.
    """
    items = materialize(short_items(benchmark), "decontaminate-short")
    n = items.count()
    if not n:
        return None
    widths = [r.width for r in items.select("width").distinct().collect()]  # WINDOW at most
    starts = small(items.select("width", "anchor", "length").distinct(), n, 24)

    def anchors(words: Column) -> Column:
        def of(width: int) -> Column:
            places = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda p: F.struct(F.lit(width).alias("width"), p.alias("p"), F.xxhash64(run_of(words, p, width)).alias("anchor")))

        return F.concat(*[of(w) for w in widths])

    spots = documents.select("doc_id", "key", F.explode(_let(tokens(F.col("text")), anchors)).alias("x")).select("doc_id", "key", "x.*")
    spots = spots.join(starts, ["width", "anchor"]).groupBy("doc_id", "key").agg(F.collect_set(F.struct("p", "length")).alias("spots"))
    spots = materialize(spots.withColumnsRenamed({"doc_id": "d", "key": "k"}), "decontaminate-spots")
    held = documents.join(spots, documents["doc_id"].eqNullSafe(spots["d"]) & (documents["key"] == spots["k"]))
    whole = lambda words, s: F.xxhash64(F.transform(F.sequence(s["p"], s["p"] + s["length"] - 1), lambda i: F.get(words, i)))
    inside = lambda words: F.filter("spots", lambda s: s["p"] + s["length"] <= F.size(words))
    wholes = _let(tokens(F.col("text")), lambda words: F.transform(inside(words), lambda s: F.struct(s["length"].alias("length"), whole(words, s).alias("whole"))))
    rows = held.select("doc_id", "key", F.explode(F.array_distinct(wholes)).alias("x")).select("doc_id", "key", "x.*")
    return rows.join(small(items.select("item_id", "item", "length", "whole"), n, 40), ["length", "whole"]).select("doc_id", "key", "item_id", "item").distinct()


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))


def _pair(spot: Column) -> Column:
    return F.struct(spot["i"].alias("i"), spot["d"].alias("d"))


def _commonest(windows: Column, spots: Column, pairs: Column) -> Column:
    """The windows of an alignment that hold, of each item value, only the document value that it meets most often;
    none if an item value has no such one."""
    counted = F.transform(pairs, lambda v: F.struct(v["i"].alias("i"), v["d"].alias("d"), F.size(F.filter(spots, lambda s: (s["i"] == v["i"]) & (s["d"] == v["d"]))).alias("n")))

    def kept(c: Column) -> Column:
        beaten = lambda v, least: F.exists(c, lambda o: (o["i"] == v["i"]) & (o["d"] != v["d"]) & (o["n"] >= v["n"] + least))
        lost = F.transform(F.filter(c, lambda v: beaten(v, 1)), _pair)
        tied = F.exists(c, lambda v: ~beaten(v, 1) & beaten(v, 0))
        clear = F.filter(windows, lambda w: ~F.exists(w["values"], lambda v: F.array_contains(lost, _pair(v))))
        return F.filter(clear, lambda w: ~tied)

    return _let(counted, kept)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, key, item_id, n_windows, n_matched, coverage, n_slots, n_changed) for each document and item that leaked into it.

    First every window of every document is looked up, by hash alone, in the benchmark's windows (a broadcast join
    if those were counted to be few, else a shuffled one) and matches are combined per task. Documents with enough
    matches, and only those, are then aligned with their items and their slots compared.
    """
    windows = materialize(benchmark_windows(benchmark), "decontaminate-items")
    n = windows.count()
    items = small(windows.select("hash", "item_id", "item", "n").distinct(), n, 64)
    documents = _documents(docs)
    seen = documents.select("doc_id", "key", F.explode(window_hashes(canonical(F.col("text")))).alias("hash")).join(items, "hash")
    found = seen.groupBy("doc_id", "key", "item_id", "item", "n").agg(F.size(F.collect_set("hash")).alias("m"))
    pairs = materialize(found.where(F.col("m") >= coverage * F.col("n")).select("doc_id", "key", "item_id", "item"), "decontaminate-pairs")
    m = pairs.count()

    ids = small(pairs.select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct(), m, 32)
    hit = documents.join(ids, documents["doc_id"].eqNullSafe(ids["d"]) & (documents["key"] == ids["k"]), "left_semi")
    hit = hit.select("doc_id", "key", window_hashes(canonical(F.col("text"))).alias("hashes"), raw_words(F.col("text")).alias("raw"))
    spot = lambda h, p: F.struct(p.alias("p"), h.alias("hash"), run_of(F.col("raw"), p, WINDOW).alias("doc_raw"))
    rows = hit.select("doc_id", "key", F.explode(F.transform("hashes", spot)).alias("x")).select("doc_id", "key", "x.*")
    aligned = rows.join(small(windows, n, 256), "hash")
    wanted = small(pairs.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("item_id").alias("i"), F.col("item").alias("t")), m, 48)
    on = aligned["doc_id"].eqNullSafe(wanted["d"]) & (aligned["key"] == wanted["k"]) & aligned["item_id"].eqNullSafe(wanted["i"]) & (aligned["item"] == wanted["t"])
    aligned = aligned.join(wanted, on, "left_semi")
    zipped = F.filter(F.arrays_zip("slots", "item_raw", "doc_raw", F.sequence(F.col("q"), F.col("q") + WINDOW - 1).alias("at")), lambda x: x["slots"])
    values = F.transform(zipped, lambda x: F.struct(F.lower(x["item_raw"]).alias("i"), F.lower(x["doc_raw"]).alias("d"), x["at"].alias("at")))
    same = F.transform("item_raw", lambda w: F.lower(w)) == F.transform("doc_raw", lambda w: F.lower(w))
    # one alignment is one distance between positions, so an item's word meets one word of the document there
    lined = aligned.groupBy("doc_id", "key", "item_id", "item", "n", (F.col("p") - F.col("q")).alias("shift")).agg(
        F.collect_list(F.struct("hash", same.alias("same"), values.alias("values"))).alias("windows")
    )
    lined = lined.withColumn("spots", F.array_distinct(F.flatten(F.col("windows.values"))))
    lined = lined.withColumn("pairs", F.array_distinct(F.transform("spots", _pair)))
    clash = F.size(F.array_distinct(F.col("pairs.i"))) != F.size("pairs")
    lined = lined.withColumn("kept", F.when(clash, _commonest(F.col("windows"), F.col("spots"), F.col("pairs"))).otherwise(F.col("windows")))
    lined = lined.withColumn("told", F.array_union("kept", F.filter("windows", lambda w: w["same"])))
    lined = lined.withColumn("pairs", F.array_distinct(F.transform(F.flatten(F.col("told.values")), _pair)))

    def over(hashes: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.collect_list(hashes))))

    out = lined.groupBy("doc_id", "key", "item_id", "item", "n").agg(
        over(F.col("kept.hash")).alias("m"),
        over(F.filter("windows", lambda w: w["same"])["hash"]).alias("verbatim"),
        over(F.col("told.hash")).cast("long").alias("n_matched"),
        F.max(F.size("pairs")).cast("long").alias("n_slots"),
        F.max(F.size(F.filter("pairs", lambda v: v["i"] != v["d"]))).cast("long").alias("n_changed"),
    )
    out = out.where((F.col("m") >= coverage * F.col("n")) | (F.col("verbatim") >= F.greatest(F.lit(coverage), F.lit(VERBATIM)) * F.col("n")))
    found = F.struct(F.col("n").alias("n_windows"), "n_matched", (F.col("n_matched") / F.col("n")).alias("coverage"), "n_slots", "n_changed")
    out = out.select("doc_id", "key", "item_id", "item", found.alias("found"))
    whole = _verbatim(documents, benchmark)
    if whole is not None:
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        held = F.struct(one.alias("n_windows"), one.alias("n_matched"), F.lit(1.0).alias("coverage"), none.alias("n_slots"), none.alias("n_changed"))
        # an item found both ways is told by its windows
        out = out.unionByName(whole.withColumn("found", held)).groupBy("doc_id", "key", "item_id", "item").agg(F.max("found").alias("found"))
    return out.select("doc_id", "key", "item_id", "found.*")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that no item leaked into, unchanged."""
    found = materialize(contaminated(docs, benchmark, coverage).select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).distinct(), "decontaminate-found")
    side = small(found, found.count(), 32)
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.withColumn("__k", key)
    return keyed.join(side, keyed["doc_id"].cast("long").eqNullSafe(side["__doc"]) & (keyed["__k"] == side["__key"]), "left_anti").drop("__k")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")
