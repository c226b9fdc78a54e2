"""Toxicity by a convolutional text classifier, trained here in numpy.

Words (runs of ASCII letters and non-ASCII bytes, ASCII folded) are hashed into 2**HASH_BITS places; a place that
occurs in LEAST_DOCS training texts or more has an embedding, others are zero. Filters of several widths run over
the embeddings, each is max-pooled over the whole text, and a logistic layer weighs them. Thresholds are calibrated
by language: the text's language is told from its own function words (never from the lang column), and out-of-fold
logits of the training rows set each language's threshold, drawn towards the common one where a language has few
positives. The score is the logistic of the distance to that threshold, so 0.5 is the decision.

Learnt from at most MOST_LABELLED labelled rows, those of least hash of their id among the rows whose CRC-32 of the id
modulo FOLDS is not 0, as whole texts of any length; in that order they are taken until LEARNT_BYTES are full, the
row that fills them included, as the driver holds them. Scoring covers whole texts of all rows and is one pass without
a shuffle.

Defined cases: a null or empty text has no words and gets the score of the bias; labels without a document, null
labels and null ids are not learnt from, a doc_id labelled twice counts as toxic if one label says so; without both
classes every score is 0; repeated rows each get a row; a null doc_id is not held out; extra columns are ignored.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import textkit as tk
from stratum.llm.common import arrow_map, table

FOLDS = 5
MOST_LABELLED = 8000
LEARNT_BYTES = 128 << 20
HASH_BITS = 28
LEAST_DOCS = 3
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
#: Share of words that training hides at a time, and spread of the first embeddings.
DROPPED = 0.2
START = 0.1
BATCH = 32
CROSS_FOLDS = 3

#: Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for with on are this be by not at from or an have",
    "fr": "le la les de des et un une du est que pour dans par sur au pas en ou il elle",
    "de": "der die das und ein eine ist von zu mit den im für auf nicht als auch dem es sich",
    "es": "el los las y un una del que es por con para se lo no su al como más o",
}

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and row of every word."""
    solid = np.where(_IN_WORD[buf], _FOLD[buf], 32).astype(np.uint8)
    starts, ends = tk.words(solid, offsets)
    return (tk.strings_of(solid, starts, ends).hash >> np.uint64(64 - HASH_BITS)).astype(np.int64), tk.rows_of(starts, offsets)


def _places_of(language: str) -> np.ndarray:
    data = np.frombuffer(FUNCTION_WORDS[language].encode(), np.uint8)
    return np.unique(words(data, np.array([0, len(data)]))[0])


_LANGUAGES = sorted(FUNCTION_WORDS)


def languages(place: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The language with the most function words in each text; the count of languages where it has none."""
    votes = np.stack([np.bincount(row[np.isin(place, _places_of(x))], minlength=n)[:n] for x in _LANGUAGES], 1)
    return np.where(votes.max(1, initial=0) > 0, votes.argmax(1), len(_LANGUAGES))


@dataclasses.dataclass
class Model:
    """Known places (sorted) and their vectors (row 0 is the unknown word), filters, output weights, thresholds."""

    places: np.ndarray
    vectors: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: np.ndarray
    scale: float = 1.0
    constant: bool = False

    def ids(self, place: np.ndarray) -> np.ndarray:
        if not len(self.places):
            return np.zeros(len(place), np.int64)
        at = np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)
        return np.where(self.places[at] == place, at + 1, 0)

    def tables(self) -> list[list[np.ndarray]]:
        """What each known word adds to each filter at each of its places: scoring is lookups and sums."""
        return [[(self.vectors @ w[t]).astype(np.float32) for t in range(len(w))] for w in self.filters]


def _pooled(parts: list[list[np.ndarray]], shifts: list[np.ndarray], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Max-pooled activations of each text; a text is followed by as many unknown words as its windows need."""
    pad = max(WIDTHS) - 1
    long = np.maximum(sizes, 1) + pad
    first = np.cumsum(long) - long
    padded = np.zeros(int(long.sum()) + pad, np.int64)
    padded[np.arange(len(ids)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)] = ids
    total = int(long.sum())
    out = []
    for tables, shift in zip(parts, shifts, strict=True):
        z = tables[0][padded[:total]]
        for t in range(1, len(tables)):
            z = z + tables[t][padded[t : total + t]]
        # windows start at the text's own words (or at the unknown word of an empty text)
        bounds = np.stack([first, first + np.maximum(sizes, 1)], 1).reshape(-1)
        out.append(np.maximum(np.maximum.reduceat(z, bounds, 0)[::2] + shift, 0))
    return np.concatenate(out, 1)


def _fit(texts: list[np.ndarray], labels: np.ndarray, places: np.ndarray, seed: int) -> Model:
    """Adam on the dense layers and Adagrad on the embeddings; max pooling sends a gradient to one window each."""
    rng = np.random.default_rng(seed)
    model = Model(
        places,
        rng.normal(0, START, (len(places) + 1, DIMENSIONS)),
        [rng.normal(0, 0.3 / np.sqrt(w), (w, DIMENSIONS, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS],
        rng.uniform(0.2, 0.5, FILTERS * len(WIDTHS)) * np.where(np.arange(FILTERS * len(WIDTHS)) % 4 == 3, -1, 1),
        float(np.log(max(labels.mean(), 1e-3) / max(1 - labels.mean(), 1e-3))),
        np.zeros(len(_LANGUAGES) + 1),
    )
    model.vectors[0] = 0
    pad = max(WIDTHS) - 1
    ids = [np.append(model.ids(t), np.zeros(pad + (len(t) == 0), np.int64)) for t in texts]
    dense = [*model.filters, *model.shifts, model.out, np.array([model.bias])]
    first, second = [np.zeros_like(x) for x in dense], [np.zeros_like(x) for x in dense]
    seen, turn = np.full(model.vectors.shape, 1e-4), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(ids))
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.001
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            turn += 1
            grads = [np.zeros_like(x) for x in dense]
            touched, pulls = [], []
            flat = np.concatenate([ids[i] for i in batch])
            flat = np.where(rng.random(len(flat)) < DROPPED, 0, flat)
            x = model.vectors[flat]
            ends = np.cumsum([len(ids[i]) for i in batch])
            begin = np.concatenate([[0], ends[:-1]])
            best, act = [], []
            for kernel, shift in zip(dense[: len(WIDTHS)], dense[len(WIDTHS) : 2 * len(WIDTHS)], strict=True):
                n = len(flat) - len(kernel) + 1
                z = sum(x[t : n + t] @ kernel[t] for t in range(len(kernel)))
                where = np.stack([a + z[a : max(a + 1, b - pad)].argmax(0) for a, b in zip(begin, ends, strict=True)])
                best.append(where)
                act.append(np.maximum(np.take_along_axis(z, where, 0) + shift, 0))
            h = np.concatenate(act, 1)
            logit = h @ dense[-2] + dense[-1][0]
            error = (1 / (1 + np.exp(-logit)) - labels[batch]) / len(batch)
            grads[-2], grads[-1] = h.T @ error, np.array([error.sum()])
            back = error[:, None] * dense[-2][None, :] * (h > 0)
            for w in range(len(WIDTHS)):
                g = back[:, w * FILTERS : (w + 1) * FILTERS]
                grads[len(WIDTHS) + w] = g.sum(0)
                kernel = dense[w]
                for t in range(len(kernel)):
                    word = best[w] + t
                    grads[w][t] = np.einsum("bfd,bf->df", x[word], g)
                    touched.append(flat[word].reshape(-1))
                    pulls.append((g[:, :, None] * kernel[t].T[None, :, :]).reshape(-1, DIMENSIONS))
            for k, (p, g) in enumerate(zip(dense, grads, strict=True)):
                g = g + 1e-4 * p * (k < len(WIDTHS))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p -= rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
            at_words, pull = np.concatenate(touched), np.concatenate(pulls)
            unique, which = np.unique(at_words, return_inverse=True)
            sums = np.zeros((len(unique), DIMENSIONS))
            np.add.at(sums, which, pull)
            sums[unique == 0] = 0
            seen[unique] += sums**2
            model.vectors[unique] -= 0.15 * sums / np.sqrt(seen[unique])
    model.filters, model.shifts = dense[: len(WIDTHS)], dense[len(WIDTHS) : 2 * len(WIDTHS)]
    model.out, model.bias = dense[-2], float(dense[-1][0])
    return model


def _logits(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    parts, out = model.tables(), []
    for at in range(0, len(texts), 256):
        some = texts[at : at + 256]
        ids = model.ids(np.concatenate(some))
        out.append(_pooled(parts, model.shifts, ids, np.array([len(t) for t in some])) @ model.out + model.bias)
    return np.concatenate(out) if out else np.zeros(0)


def _threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit between two neighbours that makes the fewest errors; of equals the middle one."""
    order = np.argsort(logits)
    z, y = logits[order], labels[order]
    errors = np.concatenate([[len(y) - y.sum()], len(y) - y.sum() + np.cumsum(2 * y - 1)])
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    if k in (0, len(z)):
        return float(z[0] - 1 if k == 0 else z[-1] + 1)
    return float((z[k - 1] + z[k]) / 2)


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """A model from texts and 0/1 labels; equal texts count once."""
    first = list(dict(zip(reversed(texts), reversed(range(len(texts))), strict=True)).values())[::-1]
    texts, labels = [texts[i] for i in first], np.asarray(labels, np.float64)[first]
    data = pa.array(texts, pa.large_string())
    bags: list[np.ndarray] = []
    spoken = []
    for a, b, buf, offsets in tk.slices(data):
        place, row = words(buf, offsets)
        bags += np.split(place, np.searchsorted(row, np.arange(1, b - a)))
        spoken.append(languages(place, row, b - a))
    empty = np.zeros(0, np.int64)
    nothing = Model(empty, np.zeros((1, DIMENSIONS)), [np.zeros((w, DIMENSIONS, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), 0.0, np.zeros(len(_LANGUAGES) + 1), constant=True)
    if not len(labels) or labels.min() == labels.max():
        return nothing
    spoken = np.concatenate(spoken)

    def known(some) -> np.ndarray:
        place, count = np.unique(np.concatenate([np.unique(bags[i]) for i in some]), return_counts=True)
        return place[count >= LEAST_DOCS]

    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(bags)) % CROSS_FOLDS
    logits = np.zeros(len(bags))
    for k in range(CROSS_FOLDS):
        inside = np.flatnonzero(fold != k)
        if labels[inside].min() == labels[inside].max():
            return nothing
        model = _fit([bags[i] for i in inside], labels[inside], known(inside), seed + k)
        logits[fold == k] = _logits(model, [bags[i] for i in np.flatnonzero(fold == k)])
    common = _threshold(logits, labels)
    thresholds = np.full(len(_LANGUAGES) + 1, common)
    for k in range(len(thresholds)):
        mine = spoken == k
        positive = labels[mine].sum()
        if 0 < positive < mine.sum():
            share = positive / (positive + 20)
            thresholds[k] = share * _threshold(logits[mine], labels[mine]) + (1 - share) * common
    model = _fit(bags, labels, known(range(len(bags))), seed)
    model.thresholds = thresholds
    return model


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_bytes: int = LEARNT_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels to learn from; the rows are chosen by id and size before any text leaves its task."""
    ids = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").where(~_held_out(F.col("id")))
    rows = rows.withColumn("key", F.xxhash64("text"))
    order = [F.xxhash64("id"), "id", "key"]
    # equal rows are one; `most` narrow rows at most reach the driver
    first = rows.select("id", "key", F.octet_length("text").cast("long").alias("bytes")).join(ids, "id").distinct().orderBy(*order).limit(most).collect()
    before = np.cumsum([0] + [r["bytes"] for r in first])[:-1]
    chosen = [(r["id"], r["key"], r["toxic"]) for r, b in zip(first, before, strict=True) if b < most_bytes]
    if not chosen:
        return [], np.zeros(0)
    wanted = docs.sparkSession.createDataFrame(chosen, "id long, key long, toxic int")
    got = rows.join(F.broadcast(wanted), ["id", "key"]).groupBy("id", "key", "toxic").agg(F.first("text").alias("text"))  # `most` rows of 20 bytes
    texts = {(r["id"], r["key"]): r["text"] for r in got.collect()}
    return [texts[i, k] for i, k, _ in chosen], np.array([t for *_, t in chosen], np.float64)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the language that the text was judged by, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches):
        m = shared.value
        parts = m.tables()
        for batch in batches:
            for at, end, buf, offsets in tk.slices(batch.column(1), 1 << 20):
                n = end - at
                place, row = words(buf, offsets)
                spoken = languages(place, row, n)
                logit = _pooled(parts, m.shifts, m.ids(place), np.bincount(row, minlength=n)[:n]) @ m.out + m.bias
                got = np.zeros(n) if m.constant else 1 / (1 + np.exp(-np.clip(m.scale * (logit - m.thresholds[spoken]), -40, 40)))
                names = pa.array([[*_LANGUAGES, "other"][k] for k in spoken])
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], pa.array(got), pa.array((got >= 0.5).astype(np.int32)), names], names=["doc_id", "score", "predicted", "spoken"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int, spoken string")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(*sample(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spoken")
