"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.llm.common import held_out, shared_folder, text_batches
from hushspan.llm.texts import code_points, labelled_sample

FOLDS, HELD_OUT = 4, 2
LENGTHS = (4, 5, 6)
#: n-grams are hashed to this many buckets.
BUCKETS = 1 << 20
#: Bound of the sample to fit on (documents of each class); all n-grams with SUPPORT are weighed.
PER_CLASS = 5_000
#: A feature must be in so many sampled documents.
SUPPORT = 8
THRESHOLD = 0.3
#: Steps at most, weight of the ridge, tasks of a step, and documents whose features are held at once.
STEPS, RIDGE, PARTS, ROWS_AT_ONCE = 60, 1e-4, 4, 256


def grams(text: str) -> np.ndarray:
    """The bucket of every n-gram of the lower-cased text; white space of any kind is one space."""
    # A space at both ends makes the first and last word look like any other.
    codes, _ = code_points([f" {' '.join(text.lower().split())} "])
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found, rolled = [], mixed
    for n in range(2, max(LENGTHS) + 1):
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + mixed[n - 1:]
        if n in LENGTHS:
            found.append((rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44))
    return np.concatenate(found).view(np.int64)


class Present:
    """Distinct buckets of texts, of the wanted ones only if they are given."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted, self.last = wanted, np.empty(BUCKETS, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        what = grams(text)
        if self.wanted is not None:
            what = what[self.wanted[what]]
        # Of repeated buckets the place noted last is kept, which takes no sort.
        places = np.arange(len(what), dtype=np.int32)
        self.last[what] = places
        return what[self.last[what] == places]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, present = np.zeros((2, BUCKETS), np.int64), Present()
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found[y, present(text.as_py())] += 1
    some = np.flatnonzero(found.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[0, some]), pa.array(found[1, some])], ["bucket", "clean", "toxic"])


class Model:
    """Weights of the buckets, with the log-count ratios multiplied in, and an intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float):
        self.buckets, self.weights, self.intercept = buckets, weights, intercept

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        wanted, weight = np.zeros(BUCKETS, bool), np.zeros(BUCKETS)
        wanted[self.buckets] = True
        weight[self.buckets] = self.weights
        return wanted, weight


def loss_and_slopes(packed: list[bytes], y: np.ndarray, weight: np.ndarray, beta: np.ndarray, intercept: float,
                    ratios: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Weighted logistic loss of some documents, its slope by the intercept and by every weight.

    A document is the list of its features, packed by `pack`; a feature's value is its ratio.
    """
    loss, by_intercept, slope = 0.0, 0.0, np.zeros(len(beta))
    scaled = beta * ratios
    for low in range(0, len(packed), ROWS_AT_ONCE):
        lists = [unpack(p) for p in packed[low:low + ROWS_AT_ONCE]]
        sizes = [len(f) for f in lists]
        features = np.concatenate([np.empty(0, np.int64), *lists])
        owner = np.repeat(np.arange(len(lists)), sizes)
        z = np.bincount(owner, scaled[features], len(lists)) + intercept
        some, each = y[low:low + ROWS_AT_ONCE], weight[low:low + ROWS_AT_ONCE]
        loss += float((each * (np.logaddexp(0, z) - some * z)).sum())
        error = each * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - some)
        by_intercept += float(error.sum())
        slope += np.bincount(features, error[owner], len(beta))
    return loss, by_intercept, slope * ratios


def pack(features: np.ndarray) -> bytes:
    """Rising numbers as their differences: two bytes each, and an escape where that is too small."""
    steps = np.diff(features, prepend=0)
    big = steps >= 0xFFFF
    return np.where(big, 0xFFFF, steps).astype("<u2").tobytes() + steps[big].astype("<u4").tobytes() + int(len(steps)).to_bytes(4, "little")


def unpack(data: bytes) -> np.ndarray:
    count = int.from_bytes(data[-4:], "little")
    steps = np.frombuffer(data, "<u2", count).astype(np.int64)
    big = steps == 0xFFFF
    steps[big] = np.frombuffer(data, "<u4", int(big.sum()), 2 * count)
    return np.cumsum(steps)


def minimised(evaluate, size: int, steps: int = STEPS, memory: int = 6, tolerance: float = 1e-4) -> np.ndarray:
    """The point where `evaluate`, giving (value, slopes), is least, by L-BFGS; it ends when the value settles."""
    at = np.zeros(size)
    value, slope = evaluate(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, weights = slope.copy(), []
        for s, g in reversed(moves):
            weights.append((s @ direction) / (s @ g))
            direction -= weights[-1] * g
        if moves:
            s, g = moves[-1]
            direction *= (s @ g) / (g @ g)
        else:
            direction /= max(1.0, float(np.sqrt(slope @ slope)))
        for (s, g), w in zip(moves, reversed(weights)):
            direction += (w - (g @ direction) / (s @ g)) * s
        down, rate = float(slope @ direction), 1.0
        while True:
            there = at - rate * direction
            new, after = evaluate(there)
            if new <= value - 1e-4 * rate * down or rate < 1e-6:
                break
            rate /= 2
        if not new < value:
            break
        s, g = there - at, after - slope
        if s @ g > 1e-12:
            moves = [*moves[-(memory - 1):], (s, g)]
        settled_now = value - new <= tolerance * max(abs(value), abs(new))
        at, value, slope = there, new, after
        if settled_now:
            break
    return at


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from a bounded sample; without labels of both classes the model says the share of label 1.

    The sampled documents' features are written once to the shared folder.  Every step is a job over
    them, in few tasks, that adds up slopes; the driver holds vectors of one number for each n-gram,
    of which there are BUCKETS at most.
    """
    sample, weight = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, PER_CLASS, doc_id, text)
    spark = docs.sparkSession
    given = sample.select("y", "text").coalesce(PARTS)
    n = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
    nothing = np.empty(0, np.int64)
    if len(n) < 2:
        return Model(nothing, nothing.astype(float), 4.0 if n.get(1) else -4.0)
    counts = text_batches(given).mapInArrow(_count, "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 1) / (n[1] + 2)) - F.log((F.col("clean") + 1) / (n[0] + 2))
    used = counts.where(F.col("toxic") + F.col("clean") >= SUPPORT).select("bucket", ratio.alias("r")).toArrow()
    order = np.argsort(np.asarray(used["bucket"]))
    buckets, ratios = np.asarray(used["bucket"])[order], np.asarray(used["r"])[order]
    total = n[1] * weight[1] + n[0] * weight[0]
    if not len(buckets):
        share = n[1] * weight[1] / total
        return Model(nothing, nothing.astype(float), float(np.log(share / (1 - share))))
    place = np.full(BUCKETS, -1, np.int64)
    place[buckets] = np.arange(len(buckets))
    places = spark.sparkContext.broadcast(place.astype(np.int32))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places.value
        present = Present(place >= 0)
        for batch in batches:
            found = [pack(np.sort(place[present(text.as_py())]).astype(np.int64)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["y", "features"])

    folder = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    (text_batches(given).mapInArrow(features, "y int, features binary")
     .write.option("compression", "zstd").parquet(folder))
    places.destroy()
    rows = spark.read.parquet(folder)
    each = np.array([weight[0], weight[1]])

    def evaluate(at: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast((at, ratios))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (at, ratios), sums = sent.value, None
            for batch in batches:
                y = np.asarray(batch.column(0))
                found = loss_and_slopes(batch.column(1).to_pylist(), y, each[y], at[:-1], float(at[-1]), ratios)
                sums = found if sums is None else tuple(a + b for a, b in zip(sums, found))
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([sums[0]]), pa.array([sums[1]]), pa.array(
                    [sums[2].astype("<f4").tobytes()], pa.binary())], ["loss", "intercept", "slopes"])

        value, slope = RIDGE / 2 * float(at[:-1] @ at[:-1]), np.append(RIDGE * at[:-1], 0.0)
        for row in rows.mapInArrow(run, "loss double, intercept double, slopes binary").collect():
            value += row["loss"] / total
            slope[-1] += row["intercept"] / total
            slope[:-1] += np.frombuffer(row["slopes"], "<f4") / total
        sent.destroy()
        return value, slope

    fitted = minimised(evaluate, len(buckets) + 1)
    return Model(buckets, fitted[:-1] * ratios, float(fitted[-1]))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text is scored as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = model.tables()
        present = Present(wanted)
        for batch in batches:
            z = np.array([weight[present(text.as_py())].sum() for text in batch.column(1)]) + model.intercept
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["doc_id", "score"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return text_batches(given).mapInArrow(run, f"doc_id {dict(given.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`.

    Learns from `labels` (doc_id, toxic) outside the held-out fold and from the texts alone.  Empty
    and null texts get the score of no n-gram; repeated rows are scored each; other columns are not
    read.
    """
    model = fit(docs, labels, doc_id, text)
    return score(docs, model, doc_id, text).select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
