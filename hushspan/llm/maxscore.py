"""Exact top-k search by inner product: MaxScore over shards of posting lists.

A component of a vector is a term, its value the term's impact.  In a shard every term has a posting
list and bounds of what it can add to a query's score.  Terms are taken in the order of how far their
bounds are apart; those at the end that cannot lift a row over the k-th best score so far, even
together, are non-essential.  The lists of the essential terms are traversed in full; the others are
probed only for rows that can still compete.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushspan.llm.common import settled

#: Rows of a shard and queries of a block; one task meets one of each, so its memory is bounded.
SHARD_ROWS, BLOCK_QUERIES = 8192, 1024
#: Rows traversed before the k-th best score is looked at again, and terms probed before rows are dropped.
STRIDE, PROBE = 2048, 8
#: Whole numbers below this are exact in double precision.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def scaled(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) with v[i] = floor(scale * x[i]), of the rows that take part."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
            .select(F.col(vec_id).cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("v")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of numbers, with 0 where a vector ends early."""
    arrays = column.combine_chunks()
    lengths = np.diff(np.asarray(arrays.offsets)) if len(arrays) else np.zeros(0, int)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = np.asarray(arrays.flatten())
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


class Shard:
    """Posting lists of some rows, with the bounds of every term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.postings = ids, np.ascontiguousarray(rows.T)
        self.most, self.least = rows.max(axis=0), rows.min(axis=0)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than `own`."""
        high = np.maximum(query * self.most, query * self.least)
        low = np.minimum(query * self.most, query * self.least)
        order = np.argsort(low - high, kind="stable")
        spread = np.append(np.cumsum((high - low)[order][::-1])[::-1], 0.0)
        rest = np.append(np.cumsum(high[order][::-1])[::-1], 0.0)
        ids, scores, enough, total = np.empty(0, np.int64), np.empty(0), -np.inf, len(self.ids)
        for start in range(0, total, STRIDE):
            part = slice(start, min(start + STRIDE, total))
            essential = len(order) if enough == -np.inf else int(np.argmax(spread <= enough - low.sum()))
            terms = order[:essential]
            sums = query[terms] @ self.postings[terms, part] if essential else np.zeros(part.stop - start)
            rows = np.flatnonzero((sums + rest[essential] >= enough) & (self.ids[part] != own))
            sums = sums[rows]
            for at in range(essential, len(order), PROBE):
                probed = order[at:at + PROBE]
                sums = sums + query[probed] @ self.postings[np.ix_(probed, rows + start)]
                near = sums + rest[min(at + PROBE, len(order))] >= enough
                rows, sums = rows[near], sums[near]
            ids, scores = np.append(ids, self.ids[part][rows]), np.append(scores, sums)
            best = _best(scores, ids, k)
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                enough = scores[-1]
        return ids, scores


def _search_block(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "query_hash": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            width = max(_longest(rows), _longest(queries))
            matrix, wanted = _matrix(rows["v"], width), _matrix(queries["v"], width)
            ids = np.asarray(rows["vec_id"])
            exact = width * _size(matrix) * _size(wanted) < EXACT
            shard = Shard(ids, matrix.astype(float)) if exact else None
            for own, tag, query in zip(np.asarray(queries["vec_id"]).tolist(), queries["h"].to_pylist(), wanted):
                if exact:
                    near, scores = shard.search(query.astype(float), own, k)
                    scores = scores.astype(np.int64)
                else:
                    near, scores = _long_numbers(ids, matrix, query, own, k)
                found["query_id"] += [own] * len(near)
                found["query_hash"] += [tag] * len(near)
                found["vec_id"] += near.tolist()
                found["score"] += scores.tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in found.items()})

    return run


def _longest(table: pa.Table) -> int:
    return max((len(v) for v in table["v"]), default=0)


def _size(matrix: np.ndarray) -> float:
    return float(np.abs(matrix.astype(float)).max()) if matrix.size else 0.0


def _long_numbers(ids, matrix, query, own, k) -> tuple[np.ndarray, np.ndarray]:
    """Every row of the shard in whole numbers of any length; scores end at the bounds of a long."""
    sums = (matrix.astype(object) * query.astype(object)).sum(axis=1)
    sums = np.array([max(-LONG - 1, min(LONG, int(s))) for s in sums], object)
    rows = [i for i in range(len(ids)) if ids[i] != own]
    rows.sort(key=lambda i: (-sums[i], ids[i]))
    return ids[rows[:k]], sums[rows[:k]].astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row that `is_query` takes.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an
    id; an empty vector scores 0 and a shorter one is read as if zeros followed.  Ties go to smaller
    ids.  Repeated query rows are answered once, repeated candidates count each; rows with the
    query's own id are no candidates.  Scaled components and scores end at the bounds of a long.

    Rows meet queries on a grid: every shard of rows with every block of queries, both of bounded
    size and dealt by a hash of the id, then the shards' best rows are merged.
    """
    rows = settled(scaled(vectors, scale, vec_id, embedding))
    asked = settled(rows.where(is_query).distinct().withColumn("h", F.xxhash64("v")))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    deal = F.xxhash64("vec_id", F.lit(17))
    left = rows.select("vec_id", "v", F.pmod(deal, F.lit(shards)).alias("shard"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    right = asked.select("vec_id", "v", "h", F.pmod(deal, F.lit(blocks)).alias("block"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        _search_block(k), "query_id long, query_hash long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
