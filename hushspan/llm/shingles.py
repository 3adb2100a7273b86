"""Near copies by the exact similarity of word shingles, with candidates from MinHash bands.

Two texts are near copies if the Jaccard similarity of their sets of shingles is SIMILARITY or more.
Candidates share a band of minima; at a similarity of 0.8 two texts share none of the 32 bands with a
chance of 3 in a million, and each candidate is held against the whole sets.

Where many texts share a band, an exact filter takes its place: with shingles in the order of how rare
they are among those texts, two near copies share one of the first few, and how far in front it stands
bounds how much they can have in common.  Texts that are alike in a frequent passage only part there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushspan.llm import simhash
from hushspan.llm.common import settled, shared_folder, text_batches
from hushspan.llm.components import connected_components

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Shingles that are hashed and permuted at once, so that a very long text needs no more memory.
BLOCK = 1 << 12
#: Texts of a key that are compared pair by pair; keys of more go through the exact filter.
CROWD = 32
#: What rounding can take from a bound.
SLACK = 1e-9
_RANDOM = np.random.default_rng(5)
_TIMES = _RANDOM.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the lower-cased words' shingles, in order; a shorter text is one shingle, no word none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = zip(*(words[k:] for k in range(width))) if len(words) >= width else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(run), 7) for run in runs), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of ROWS minima; texts without a word have no keys."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        # The high half of a product depends on all bits of the hash.
        mixed = hashes[at:at + BLOCK] ^ (hashes[at:at + BLOCK] >> np.uint64(31))
        np.minimum(least, (mixed * _TIMES + _PLUS).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def _described(width: int, by_simhash: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            sets = [shingles(t, width) for t in texts]
            whole = pa.array([_name(s) for s in sets], pa.int64())
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            fps = np.fromiter((simhash.fingerprint(t) if by_simhash else 0 for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), whole, pa.array([len(s) for s in sets], pa.int32()), keys,
                 pa.array(fps.view(np.int64))],
                ["doc_id", "text_hash", "whole", "n", "keys", "fp"])
    return run


def _name(found: np.ndarray) -> int:
    """A hash that stands for a whole set."""
    name = xxhash.xxh64_intdigest(found.tobytes(), 3)
    return name - (1 << 64) if name >> 63 else name


def _listed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Copies of a text are listed once in a task.
        seen: set[int] = set()
        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py(), width)
                name = _name(found)
                if name not in seen:
                    seen.add(name)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name], pa.int64()), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], ["whole", "found"])
    return run


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, counted exactly."""
    left = sets.select(F.col("whole").alias("a"), F.col("found").alias("a_found"))
    right = sets.select(F.col("whole").alias("b"), F.col("found").alias("b_found"))
    n, m = F.size("a_found"), F.size("b_found")
    both = F.size(F.array_intersect("a_found", "b_found"))
    return pairs.join(left, "a").join(right, "b").where(both >= similarity * (n + m - both)).select("a", "b")


def _near_in_size(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m)


def _pairs(at: DataFrame, near: Column) -> DataFrame:
    """Distinct pairs (a, b) of texts that share a key, where `near` holds of the columns and those of the other (to_...)."""
    other = at.select("key", *[F.col(c).alias(f"to_{c}") for c in at.columns if c != "key"])
    met = at.join(other, "key").where((F.col("whole") < F.col("to_whole")) & near)
    return met.select(F.col("whole").alias("a"), F.col("to_whole").alias("b")).distinct()


def _front(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, whole, n, p): of each set the rarest shingles, so many that near copies share one of them.

    A shingle is a key, `p` its place in the set's order from rare to frequent.  |A and B| is at least
    `similarity` |A|, so of A's shingles all but that many, and one more, are enough.  A shingle that
    no other set has is left out, but counts for the places of the others.
    """
    every = sets.select("whole", F.size("found").alias("n"), F.explode("found").alias("key"))
    often = every.groupBy("key").agg(F.count("*").alias("df"))
    ordered = every.join(often, "key").groupBy("whole").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "key"))).alias("order"))
    enough = (F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - SLACK) + 1).cast("int")
    front = ordered.select("whole", "n", F.posexplode(F.slice("order", F.lit(1), enough)).alias("p", "s"))
    return front.where("s.df > 1").select(F.col("s.key").alias("key"), "whole", "n", "p")


def _crowded(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the sets as all their similar pairs do.

    The texts of a shingle in front are first held against the one that has the fewest rare shingles
    before it, which in a group of near copies is the nearest to what they were made from.  What that
    joins is not compared again; of all other pairs those are that size and places allow.
    """
    front = settled(_front(sets, similarity))
    share = similarity / (1 + similarity)

    def allowed(n: Column, p: Column, m: Column, q: Column) -> Column:
        wanted = share * (n + m) - SLACK
        return _near_in_size(n, m, similarity) & (n - p >= wanted) & (m - q >= wanted)

    centres = front.groupBy("key").agg(F.min(F.struct("p", "whole", "n")).alias("m"))
    first = front.join(centres, "key").where(
        (F.col("whole") != F.col("m.whole")) & allowed(F.col("n"), F.col("p"), F.col("m.n"), F.col("m.p")))
    first = first.select(F.least("whole", "m.whole").alias("a"), F.greatest("whole", "m.whole").alias("b")).distinct()
    found = settled(_alike(first, sets, similarity))
    roots = connected_components(found).withColumnRenamed("node", "whole")
    at = front.join(roots, "whole", "left").withColumn("root", F.coalesce("root", "whole"))
    mixed = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    near = (F.col("root") != F.col("to_root")) & allowed(F.col("n"), F.col("p"), F.col("to_n"), F.col("to_p"))
    return found.union(_alike(_pairs(at.join(mixed, "key"), near), sets, similarity))


def links(keyed: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that join the texts of `keyed` (key, whole, n, c) as all similar pairs that share a key do.

    Pairs of a key of CROWD texts or fewer (`c` counts them) are compared if their sizes allow it; the texts
    of larger keys go through the exact filter together.  Neither loses a pair or compares all of a group's.
    """
    few = _pairs(keyed.where(F.col("c") <= CROWD).drop("c"), _near_in_size(F.col("n"), F.col("to_n"), similarity))
    crowd = keyed.where(F.col("c") > CROWD).select("whole").distinct()
    many = sets.join(crowd, "whole", "left_semi")
    return settled(_alike(few, sets, similarity)).union(_crowded(settled(many), similarity))


def simhash_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join the sets of `rows` (whole, fp) as fingerprints equal or within the radius do."""
    both = settled(rows.select("fp", "whole").distinct())
    first = settled(both.groupBy("fp").agg(F.min("whole").alias("first")))
    equal = both.join(first, "fp").where("whole != first").select(F.col("first").alias("a"), F.col("whole").alias("b"))
    near = (simhash.links(first.select("fp"))
            .join(first.select(F.col("fp").alias("a"), F.col("first").alias("a_first")), "a")
            .join(first.select(F.col("fp").alias("b"), F.col("first").alias("b_first")), "b"))
    return equal.union(near.select("a_first", "b_first"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                similarity: float = SIMILARITY, by_simhash: bool = False) -> DataFrame:
    """(doc_id, text_hash, root) of every row: `root` stands for its group, `text_hash` for its text.

    Texts with equal sets of shingles are one before anything is compared; null and wordless texts
    have the empty set and are equal.  With `by_simhash` the links of SimHash fingerprints join groups as
    well: it counts repeats and sets of shingles do not, so each finds copies that the other misses.  A text
    is read once for both, and all links are joined at once.  Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"),
                        F.xxhash64(text).alias("text_hash"))
    kind = dict(given.dtypes)["doc_id"]
    rows = settled(text_batches(given).mapInArrow(
        _described(width, by_simhash), f"doc_id {kind}, text_hash long, whole long, n int, keys array<long>, fp long"))
    classes = rows.groupBy("whole").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("text_hash").alias("text_hash"))
    keyed = settled(classes.select("whole", "n", "text_hash", F.explode("keys").alias("key")))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    keyed = settled(keyed.join(shared, "key"))
    # One text of each class that has a candidate is read again; from files Spark knows the list's size
    # and broadcasts it only if it is small.
    folder = f"{shared_folder(spark)}/read-again-{uuid.uuid4().hex}"
    keyed.select("text_hash").distinct().write.parquet(folder)
    again = given.join(spark.read.parquet(folder), "text_hash", "left_semi")
    listed = text_batches(again.select("text")).mapInArrow(_listed(width), "whole long, found array<long>")
    sets = settled(listed.dropDuplicates(["whole"]))
    found = links(keyed.select("key", "whole", "n", "c"), sets, similarity)
    if by_simhash:
        found = found.union(simhash_links(rows))
    roots = connected_components(found)
    return rows.select("doc_id", "text_hash", "whole").join(
        roots.withColumnRenamed("node", "whole"), "whole", "left").select(
        "doc_id", "text_hash", F.coalesce("root", "whole").alias("root"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each group of near copies, by SimHash or by shingles, one with the smallest id.

    Rows are known by id and text, so an id that different texts repeat costs no other group its row.
    Rows without an id take no part and stay.  All columns are kept as they are.
    """
    named = docs.where(F.col(doc_id).isNotNull())
    rows = near_copies(named, doc_id, text, width, similarity, by_simhash=True)
    kept = rows.groupBy("root").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("m")).select(
        F.col("m.doc_id").alias("__kept"), F.col("m.text_hash").alias("__text"))
    order = F.row_number().over(Window.partitionBy("__kept", "__text").orderBy(F.col(text)))
    out = named.join(kept, (F.col(doc_id) == F.col("__kept")) & (F.xxhash64(text) == F.col("__text")))
    return out.withColumn("__copy", order).where("__copy = 1").select(*docs.columns).unionByName(
        docs.where(F.col(doc_id).isNull()))
