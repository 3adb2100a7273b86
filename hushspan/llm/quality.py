"""Quality classifier: gated-attention multiple-instance learning over a document's passages.

Every passage of a document is encoded from its form (18 shares and counts) and its words (the mean of
learned vectors of their hashes); an attention learned from document labels alone says how much each
passage counts, and the weighted mean of the encodings is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.llm.common import held_out, text_batches
from hushspan.llm.texts import code_points, labelled_sample, slices, sums

FOLDS, HELD_OUT = 5, 0
#: Words of a passage; the last one of a document may be shorter.
PASSAGE = 48
#: Bound of the sample to fit on: documents of each class.
PER_CLASS = 4_000
#: Bound of what is fitted of one document: this many of its passages, evenly spread.  All are scored.
PASSAGES_FIT = 16
#: Hash buckets of words, each with a vector.
BUCKETS = 1 << 13
THRESHOLD = 0.3
HIDDEN, GATE = 16, 8
EPOCHS, BATCH, RATE, RIDGE, SEED = 30, 64, 0.01, 1e-4, 7

SPACE, LETTER, UPPER, DIGIT, MARK, SYMBOL = (1 << i for i in range(6))
#: Kinds of the first code points; those beyond are letters.
KNOWN = 0x3000


def _kinds() -> np.ndarray:
    kinds = np.full(KNOWN + 1, LETTER, np.uint8)
    for code in range(KNOWN):
        char = chr(code)
        kinds[code] = (SPACE if char.isspace() else LETTER | UPPER if char.isupper() else LETTER if char.isalpha()
                       else DIGIT if char.isdigit() else MARK if char in ".,;:!?'\"()-" else SYMBOL)
    return kinds


KINDS = _kinds()
FEATURES = ("words", "length", "length_spread", "letters", "upper", "digits", "marks", "symbols", "lone_symbols",
            "same_as_last", "seen_before", "same_as_second_last", "capitalised", "ends_sentence", "lines", "ends_in_symbol",
            "long_words", "short_words")


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, owner, words, buckets) of the passages of all texts, in order.

    `words` says how many of `buckets`, the hashes of all words one after the other, are a passage's.  A
    text without words has one passage of zeros without words.
    """
    codes, bounds = code_points(texts)
    kind = KINDS[np.minimum(codes, KNOWN)]
    owner_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    blank = (kind & SPACE) > 0
    new_text = np.zeros(len(codes), bool)
    new_text[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(~blank & (np.r_[True, blank][:-1] | new_text))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros((len(texts), len(FEATURES))), np.arange(len(texts)), np.zeros(len(texts), np.int64), none
    stop = ~blank & (np.r_[blank[1:], True] | np.r_[new_text[1:], True])
    ends = np.flatnonzero(stop) + 1
    length = (ends - starts).astype(float)
    word_owner = owner_of[starts]
    first = np.searchsorted(word_owner, np.arange(len(texts)))
    number = np.arange(len(starts)) - first[word_owner]
    # Passages start at every PASSAGE-th word of a text.
    opens = np.flatnonzero(number % PASSAGE == 0)
    edge = np.r_[opens, len(starts)]
    owner = word_owner[opens]
    place = np.arange(len(codes)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(codes)]))
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    mixed[blank] = 0
    word = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), starts)
    passage = np.repeat(np.arange(len(opens)), np.diff(edge))

    def lag(k: int) -> np.ndarray:
        same = np.zeros(len(word))
        same[k:] = (word[k:] == word[:-k]) & (passage[k:] == passage[:-k])
        return same

    order = np.lexsort((word, passage))
    again = np.zeros(len(word))
    again[order[1:]] = (word[order][1:] == word[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    count = np.diff(edge).astype(float)
    # Characters from the first word of a passage up to the first word of the next one.
    reach = np.r_[starts[opens], len(codes)]
    last_char = kind[ends - 1]
    lone = (np.add.reduceat((kind & SYMBOL > 0).astype(float), starts) == length) & (length <= 3)

    def per_char(mask: int) -> np.ndarray:
        return sums(kind & mask > 0, reach) / np.maximum(sums(~blank, reach), 1)

    def per_word(values: np.ndarray) -> np.ndarray:
        return sums(values, edge) / count

    mean = per_word(np.minimum(length, 40))
    out = np.stack([
        count / PASSAGE, mean / 8, np.sqrt(np.maximum(per_word(np.minimum(length, 40) ** 2) - mean ** 2, 0)) / 4,
        per_char(LETTER), per_char(UPPER), per_char(DIGIT), per_char(MARK), per_char(SYMBOL), per_word(lone),
        per_word(lag(1)), per_word(again), per_word(lag(2)), per_word(kind[starts] & UPPER > 0),
        per_word(last_char & MARK > 0), sums(codes == 10, reach) / count, per_word(last_char & SYMBOL > 0),
        per_word(length > 12), per_word(length < 3)], axis=1)
    empty = np.flatnonzero(np.bincount(owner, minlength=len(texts)) == 0)
    out = np.concatenate([out, np.zeros((len(empty), len(FEATURES)))])
    owner = np.concatenate([owner, empty])
    words = np.concatenate([np.diff(edge), np.zeros(len(empty), np.int64)])
    order = np.argsort(owner, kind="stable")
    return out[order], owner[order], words[order], bucket(word)


def bucket(word: np.ndarray) -> np.ndarray:
    """The bucket of each word's hash."""
    mixed = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def spread_out(owner: np.ndarray, most: int) -> np.ndarray:
    """Which passages are fitted: all of a document with at most `most`, else `most` evenly spread ones."""
    first, total = np.searchsorted(owner, owner), np.bincount(owner)[owner]
    place = (np.arange(len(owner)) - first) * most // np.maximum(total, most)
    return (total <= most) | (np.r_[-1, place[:-1]] != place) | (np.arange(len(owner)) == first)


class Attention:
    """Encoder, gated attention and scorer; the parameters are plain arrays."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        random = np.random.default_rng(SEED)
        size = lambda *shape: random.standard_normal(shape) / np.sqrt(shape[0])
        self.mean, self.spread = mean, spread
        self.p = {"E": size(len(mean), HIDDEN), "e": np.zeros(HIDDEN), "V": size(HIDDEN, GATE), "U": size(HIDDEN, GATE),
                  "w": size(GATE, 1)[:, 0], "c": size(HIDDEN, 1)[:, 0], "d": np.zeros(1),
                  "W": np.zeros((BUCKETS, HIDDEN))}

    def forward(self, x: np.ndarray, starts: np.ndarray, owner: np.ndarray, words: np.ndarray, buckets: np.ndarray) -> tuple:
        """Passages of documents one after the other; `starts` is where each document begins."""
        p = self.p
        x = np.clip((x - self.mean) / self.spread, -5, 5)
        passage = np.repeat(np.arange(len(x)), words)
        means = np.stack([np.bincount(passage, column[buckets], len(x)) for column in p["W"].T.copy()], axis=1)
        h = np.tanh(x @ p["E"] + p["e"] + means / np.maximum(words, 1)[:, None])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, starts)[owner])
        a = a / np.add.reduceat(a, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts)
        return x, h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))

    def slopes(self, x, starts, owner, words, buckets, y, weight) -> dict[str, np.ndarray]:
        """Of the weighted mean of the logistic loss, by each parameter."""
        p = self.p
        x, h, t, g, a, z, score = self.forward(x, starts, owner, words, buckets)
        error = weight * (score - y) / weight.sum()
        dz = (error[:, None] * p["c"])[owner]
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, starts)[owner])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        each = np.repeat((dh / np.maximum(words, 1)[:, None]).T, words, axis=1)
        dw = np.stack([np.bincount(buckets, column, BUCKETS) for column in each], axis=1)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds,
                "c": z.T @ error, "d": error.sum(keepdims=True), "W": dw}

    def score(self, texts: list[str]) -> np.ndarray:
        x, owner, words, buckets = passages(texts)
        return self.forward(x, np.searchsorted(owner, np.arange(len(texts))), owner, words, buckets)[-1]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Attention | float:
    """Learn from a bounded sample, whose passages are encoded where the texts lie.

    The driver gets at most PASSAGES_FIT passages of 18 numbers and 48 buckets of each document.  Without
    labels of both classes there is nothing to learn and the share of label 1 is returned.
    """
    sample, weight = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, PER_CLASS, doc_id, text)
    width = len(FEATURES)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in slices(texts):
                x, owner, words, buckets = passages(texts[part])
                taken = spread_out(owner, PASSAGES_FIT)
                x, owner, buckets, words = x[taken], owner[taken], buckets[np.repeat(taken, words)], words[taken]
                at = np.searchsorted(owner, np.arange(part.stop - part.start + 1)).astype(np.int32)
                lists = [(at * width, x.ravel(), np.float32), (at, words, np.int16),
                         (np.r_[0, np.cumsum(words)][at], buckets, np.int16)]
                kept = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1)]
                    + [pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(values.astype(kind))) for ends, values, kind in lists],
                    ["doc_id", "y", "x", "words", "buckets"])

    schema = f"doc_id {dict(sample.dtypes)['doc_id']}, y int, x array<float>, words array<short>, buckets array<short>"
    rows = text_batches(sample).mapInArrow(encode, schema).toArrow().sort_by("doc_id")
    y = np.asarray(rows["y"], float)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    x, words, buckets = (np.asarray(rows[name].combine_chunks().flatten()) for name in ("x", "words", "buckets"))
    x, words = x.astype(float).reshape(-1, width), words.astype(np.int64)
    bounds = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(rows["words"])))]
    word_at = np.r_[0, np.cumsum(words)]
    model = Attention(x.mean(axis=0), x.std(axis=0) + 1e-3)
    each = np.where(y == 1, weight.get(1, 1.0), weight.get(0, 1.0))
    random = np.random.default_rng(SEED)
    m, v = ({k: np.zeros_like(value) for k, value in model.p.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(y))
        for start in range(0, len(y), BATCH):
            docs_at = order[start:start + BATCH]
            take = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in docs_at])
            found = np.concatenate([buckets[word_at[bounds[i]]:word_at[bounds[i + 1]]] for i in docs_at])
            counts = bounds[docs_at + 1] - bounds[docs_at]
            owner, step = np.repeat(np.arange(len(docs_at)), counts), step + 1
            slope = model.slopes(x[take], np.r_[0, np.cumsum(counts)[:-1]], owner, words[take], found, y[docs_at], each[docs_at])
            for k, s in slope.items():
                s = s + RIDGE * model.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * s, 0.999 * v[k] + 0.001 * s * s
                rate = RATE * (0.5 + 0.5 * np.cos(np.pi * epoch / EPOCHS))
                model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def score(docs: DataFrame, model: Attention | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text is scored as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                some = texts[part]
                scores = np.full(len(some), model) if isinstance(model, float) else model.score(some)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(some)), pa.array(scores)], ["doc_id", "score"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return text_batches(given).mapInArrow(run, f"doc_id {dict(given.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`.

    Learns from `labels` (doc_id, quality) outside the held-out fold and from the texts alone.  A text
    without words is one passage of zeros; every passage of a long text takes part; repeated rows are
    scored each; other columns are not read.
    """
    model = fit(docs, labels, doc_id, text)
    return score(docs, model, doc_id, text).select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
