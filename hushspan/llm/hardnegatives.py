"""Hard negatives by inner product, found by coordinate pruning over buckets of equal length.

The rows of a shard are dealt into buckets by the length of their vectors, longest first.  In a bucket
a score asks for a least cosine with the anchor, and the coordinates of unit vectors that reach it lie
in known ranges: with angles a and b to an axis, the cosine is at most cos(a - b).  Every bucket keeps
its coordinates sorted, so the ranges of the anchor's largest (focus) coordinates are found by binary
search; rows that lie in all of them are verified by their exact whole-number score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushspan.llm.common import settled
from hushspan.llm.maxscore import EXACT, LONG
from hushspan.llm.maxscore import _matrix as matrix

#: Rows of a shard and anchors of a block; one task meets one of each, so its memory is bounded.
SHARD_ROWS, BLOCK_ANCHORS = 8192, 1024
#: Rows of a bucket, and coordinates of an anchor whose ranges are intersected.
BUCKET, FOCUS = 512, 4
#: What rounding can add to a cosine or an angle; ranges are wider by it, so no row is lost.
SLACK = 1e-9


class Bucket:
    """Rows of about the same length with their unit coordinates in sorted lists."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.rows, self.longest = rows, float(lengths.max())
        self.vectors = vectors
        self.units = vectors / np.maximum(lengths, np.finfo(float).tiny)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, axis: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of a coordinate in order and whose they are; sorted when first asked for."""
        if axis not in self.lists:
            order = np.argsort(self.units[:, axis], kind="stable")
            self.lists[axis] = (self.units[order, axis], order)
        return self.lists[axis]

    def feasible(self, anchor: np.ndarray, axes: np.ndarray, cosine: float) -> np.ndarray:
        """Places of rows that lie in the feasible range of every focus coordinate of the unit vector `anchor`."""
        reach = np.arccos(min(1.0, cosine)) + SLACK
        angles = np.arccos(np.clip(anchor[axes], -1.0, 1.0))
        lows = np.cos(np.minimum(angles + reach, np.pi)) - SLACK
        highs = np.cos(np.maximum(angles - reach, 0.0)) + SLACK
        best, places = len(self.rows) + 1, None
        for axis, low, high in zip(axes.tolist(), lows, highs):
            values, order = self.sorted_list(axis)
            start, end = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            if end - start < best:
                best, places = end - start, order[start:end]
        if best < len(self.rows) and len(axes) > 1 and best:
            near = self.units[np.ix_(places, axes)]
            places = places[((near >= lows) & (near <= highs)).all(axis=1)]
        return places


class Index:
    """Length buckets of some rows, longest first."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray):
        lengths = np.sqrt((vectors[rows] ** 2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.buckets = [Bucket(rows[part], vectors[rows[part]], lengths[part])
                        for part in (order[at:at + BUCKET] for at in range(0, len(rows), BUCKET))]

    def reaching(self, anchor: np.ndarray, threshold):
        """(rows, scores) of each bucket in turn: all that score `threshold()` or more are among them.

        The threshold may rise from bucket to bucket; the scores of the rows given are exact.
        """
        length = float(np.sqrt(anchor @ anchor))
        unit = anchor / length if length else anchor
        axes = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        for bucket in self.buckets:
            least, most = threshold(), length * bucket.longest
            if least > 0:
                if least > most * (1 + SLACK):
                    return
                places = bucket.feasible(unit, axes, least / most) if len(axes) else np.arange(len(bucket.rows))
                if len(places):
                    yield bucket.rows[places], bucket.vectors[places] @ anchor
            else:
                yield bucket.rows, bucket.vectors @ anchor


@dataclass
class Best:
    """The k highest scores between two bounds so far, ties to smaller ids."""

    k: int
    low: float
    high: float
    ids: np.ndarray
    scores: np.ndarray

    @classmethod
    def of(cls, k: int, low: float = -np.inf, high: float = np.inf) -> Best:
        return cls(k, low, high, np.empty(0, np.int64), np.empty(0))

    def threshold(self) -> float:
        return max(self.low, self.scores[-1]) if len(self.scores) == self.k else self.low

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        near = (scores >= self.threshold()) & (scores <= self.high)
        if near.any():
            ids, scores = np.concatenate([self.ids, ids[near]]), np.concatenate([self.scores, scores[near]])
            order = np.lexsort((ids, -scores))[:self.k]
            self.ids, self.scores = ids[order], scores[order]


class Shard:
    """Some rows, indexed by length as a whole and label by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, exact: bool):
        self.ids, self.labels, self.exact = ids, labels, exact
        self.vectors = vectors.astype(float) if exact else vectors.astype(object)
        self.indexes: dict = {}

    def index(self, label: int | None) -> Index:
        """The rows of one label, or all rows; built when first asked for."""
        if label not in self.indexes:
            rows = np.arange(len(self.ids)) if label is None else np.flatnonzero(self.labels == label)
            self.indexes[label] = Index(self.vectors, rows)
        return self.indexes[label]

    def collect(self, own: int, label: int, anchor: np.ndarray, same: bool, bests: list[Best]) -> None:
        """Give every one of `bests` the rows of the same or of other labels that it asks for."""
        if self.exact:
            found = self.index(label if same else None).reaching(
                anchor.astype(float), lambda: min(b.threshold() for b in bests))
        else:
            found = [self._long_numbers(anchor)]
        for rows, scores in found:
            kept = (self.ids[rows] != own) & ((self.labels[rows] == label) == same)
            for best in bests:
                best.take(self.ids[rows[kept]], scores[kept])

    def _long_numbers(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every row in whole numbers of any length; scores end at the bounds of a long."""
        sums = (self.vectors * anchor.astype(object)).sum(axis=1) if self.vectors.size else np.zeros(len(self.ids), object)
        return np.arange(len(self.ids)), np.array([max(-LONG - 1, min(LONG, int(s))) for s in sums], object)


def _grid(rows: pa.Table, anchors: pa.Table):
    """The shard and the anchors of a block, with vectors of one width."""
    width = max(max(map(len, rows["v"])), max(map(len, anchors["v"])))
    vectors, asked = matrix(rows["v"], width), matrix(anchors["v"], width)
    size = [float(np.abs(m.astype(float)).max()) if m.size else 0.0 for m in (vectors, asked)]
    shard = Shard(np.asarray(rows["vec_id"]), np.asarray(rows["label"]), vectors, width * max(size) ** 2 < EXACT)
    return shard, zip(anchors["vec_id"].to_pylist(), anchors["h"].to_pylist(), anchors["label"].to_pylist(), asked)


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: dict[str, list] = {n: [] for n in ("anchor_id", "h", "positive_id", "positive_score")}
        if len(rows) and len(anchors):
            shard, asked = _grid(rows, anchors)
            for own, tag, label, anchor in asked:
                best = Best.of(k)
                shard.collect(own, label, anchor, True, [best])
                for name, values in zip(found, ([own] * len(best.ids), [tag] * len(best.ids), best.ids, best.scores)):
                    found[name] += [int(v) for v in values]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in found.items()})

    return run


def _negatives(k: int, least: int, most: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: dict[str, list] = {n: [] for n in (
            "anchor_id", "h", "place", "positive_id", "positive_score", "negative_id", "negative_score")}
        if len(rows) and len(anchors):
            shard, asked = _grid(rows, anchors)
            for (own, tag, label, anchor), given in zip(asked, anchors["positives"].to_pylist()):
                # Whole-number bounds of least * p <= 100 * n <= most * p; none where they cross.
                bests = [Best.of(k, -(-least * p["score"] // 100), most * p["score"] // 100) for p in given]
                use = [b for b in bests if b.low <= b.high]
                if use:
                    shard.collect(own, label, anchor, False, use)
                for place, (p, best) in enumerate(zip(given, bests)):
                    count = len(best.ids)
                    for name, values in zip(found, ([own] * count, [tag] * count, [place] * count, [p["id"]] * count,
                                                    [p["score"]] * count, best.ids, best.scores)):
                        found[name] += [int(v) for v in values]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in found.items()})

    return run


def _met(rows: DataFrame, anchors: DataFrame, run, schema: str) -> DataFrame:
    """Every shard of rows with every block of anchors, both dealt by a hash of the id."""
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    deal = F.xxhash64("vec_id", F.lit(12))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = rows.withColumn("shard", F.pmod(deal, F.lit(shards))).withColumn("block", every(blocks))
    right = anchors.withColumn("block", F.pmod(deal, F.lit(blocks))).withColumn("shard", every(shards))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, schema)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 10,
         least: int = 30, most: int = 90, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Every row that `is_anchor` takes is an anchor; its positives are the `positives` rows of the same
    label that score highest with it, its negatives for each of them the `negatives` highest of the
    rows of other labels whose score is `least` to `most` hundredths of the positive's.  A score is
    the inner product of the components floor(scale * x); ties go to smaller ids.

    Rows without an id or a label, and vectors that are null or hold null or non-finite components,
    take no part.  Rows with the anchor's own id are neither positives nor negatives.  Repeated anchor
    rows are answered once, other repeated rows count each; anchors that share an id and differ are
    answered each.  A shorter vector is read as if zeros followed, an empty one scores 0.  Scaled
    components and scores end at the bounds of a long.  Other columns are not read.
    """
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    named = F.col(label) if isinstance(label, str) else label
    rows = settled(
        vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
        .select(F.col(vec_id).cast("long").alias("vec_id"), named.cast("long").alias("label"),
                F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("v"),
                F.coalesce(is_anchor, F.lit(False)).alias("asks")).where(F.col("label").isNotNull()))
    anchors = settled(rows.where("asks").select("vec_id", "label", "v").distinct()
                      .withColumn("h", F.xxhash64("label", "v")))
    rows = rows.select("vec_id", "label", "v")
    near = _met(rows, anchors, _positives(positives), "anchor_id long, h long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id", "h").orderBy(F.col("positive_score").desc(), "positive_id")
    near = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives)
    given = near.groupBy("anchor_id", "h").agg(F.sort_array(F.collect_list(F.struct(
        "k", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    asked = settled(anchors.join(given.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "h"]))
    found = _met(rows, asked, _negatives(negatives, least, most),
                 "anchor_id long, h long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "h", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def query(vectors: DataFrame) -> DataFrame:
    """Anchors are every hundredth row; every seventh row's label first becomes the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % 100 == 0, moved)


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM r AS a JOIN r AS c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k
    FROM s WHERE same)
  WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id
  WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
