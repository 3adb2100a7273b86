"""Texts as arrays of code points, and bounded samples of labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.llm.common import held_out, id_text, settled

#: Characters of text that a task holds as arrays at once; one longer text is held alone.
AT_ONCE = 1 << 20


def slices(texts: list[str | None], at_once: int = AT_ONCE) -> Iterator[slice]:
    """Runs of texts of about `at_once` characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= at_once or i + 1 == len(texts):
            yield slice(start, i + 1)
            start, size = i + 1, 0


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and where each text starts (with the end)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive `bounds`; 0 for an empty stretch."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return run[bounds[1:]] - run[bounds[:-1]]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int,
                    doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, y, text) of at most `per_class` documents of each class, and the weight of each class.

    Only labels outside the held-out fold are read; the documents with the smallest hashes of their
    ids are taken.  A label that is null is none; of several labels of a document the largest
    counts.  The ids of the sample are few enough, by `per_class`, to be sent to every executor, so
    no text is shuffled.  A weight is how many labelled documents one of the sample stands for.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", folds, fold))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where("y IN (0, 1)"))
    known = settled(known.withColumn("h", F.xxhash64(id_text("doc_id"), F.lit(label))))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in totals:
        some = known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class).select("doc_id", "y")
        picked = some if picked is None else picked.union(some)
    if picked is None:
        picked = known.select("doc_id", "y")
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = settled(given.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text"))
    return sample, {y: n / min(n, per_class) for y, n in totals.items()}
