"""Near-duplicate texts by SimHash, with candidates from pivot distance tables.

A fingerprint's Hamming distances to a set of reference fingerprints (pivots) bound its distance to
any other fingerprint from below: |d(f, p) - d(g, p)| <= d(f, g) for every pivot p.  The pivots are
zero and 32 masks of two adjacent bits, so the table also tells how many bits of each pair of bits
are set, and a link can change at most two of these 32 counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushspan.llm.common import settled, text_batches
from hushspan.llm.components import connected_components

BITS = 64
RADIUS = 2
#: Reference fingerprints: zero first, then each pair of bits.
PIVOTS = [0] + [3 << (2 * j) for j in range(32)]
#: The 32 pairs of bits in five groups; two of them can hold all that a link changes.
GROUPS = [range(0, 6), range(6, 12), range(12, 18), range(18, 25), range(25, 32)]
#: A key with more fingerprints is resolved through their neighbours, not by comparing them.
CROWD = 64
#: Shingles that are hashed and counted at once, so that a very long text needs no more memory.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the lower-cased words' shingles; 0 for no text or no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    ones, total = np.zeros(BITS, np.int64), len(words) - width + 1
    for at in range(0, total, BLOCK):
        part = words[at:at + BLOCK + width - 1]
        runs = zip(*(part[k:] for k in range(width)))
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(run), 42) for run in runs), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a long."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return text_batches(given).mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, d0 to d4, key): the distances to the pivots, eight to a long after the one to zero, once for each key.

    There is one key for each choice of three groups: which groups, and their counts of set bits.  A
    pair of bits has (d(f, 0) + 2 - d(f, pivot)) / 2 bits set.  Linked fingerprints differ in two
    counts at most, so some three of the five groups agree.
    """
    pivots = np.array(PIVOTS, np.uint64)
    choices = list(combinations(GROUPS, 3))
    for batch in batches:
        fps = batch.column(0).to_numpy()
        far = np.bitwise_count(fps.view(np.uint64)[:, None] ^ pivots)
        packed = np.ascontiguousarray(far[:, 1:]).view("<i8")
        counts = (far[:, :1].astype(np.int64) + 2 - far[:, 1:]) >> 1
        keys = np.empty((len(fps), len(choices)), np.int64)
        for number, groups in enumerate(choices):
            key = np.full(len(fps), number, np.int64)
            for j in (j for group in groups for j in group):
                key = key << 2 | counts[:, j]
            keys[:, number] = key
        table = [fps, far[:, 0].astype(np.int64), *packed.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, len(choices))) for c in table] + [pa.array(keys.reshape(-1))],
                                         ["fp", "d0", "d1", "d2", "d3", "d4", "key"])


def _pivot_distance(j: int, side: str = "") -> Column:
    """Distance to pivot j from the packed table."""
    if j == 0:
        return F.col(f"{side}d0")
    return F.shiftright(F.col(f"{side}d{(j - 1) // 8 + 1}"), 8 * ((j - 1) % 8)).bitwiseAND(F.lit(255))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints `fps` (fp) as all pairs within the radius do.

    Keys from the distance table find the candidates; pairs whose largest coordinate difference is
    over the radius go, and the others are verified.  A key that more than CROWD fingerprints share
    is not compared pair by pair: its fingerprints list every reference at distance 0 or 1, at most
    65 fingerprints share such a reference, and those are within the radius of each other.  Both
    ways are exact, and every link is either found or implied by a chain of found ones.
    """
    # The table and the keys are made in tasks, once: as columns they would make plans of thousands of terms.
    keyed = settled(fps.select("fp").mapInArrow(_keyed, "fp long, d0 long, d1 long, d2 long, d3 long, d4 long, key long"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = settled(keyed.join(counts, "key"))
    few = shared.where(F.col("n") <= CROWD)
    left = few.select("key", *[F.col(c).alias(f"a_{c}") for c in ("fp", "d0", "d1", "d2", "d3", "d4")])
    right = few.select("key", *[F.col(c).alias(f"b_{c}") for c in ("fp", "d0", "d1", "d2", "d3", "d4")])
    apart = F.greatest(*[F.abs(_pivot_distance(j, "a_") - _pivot_distance(j, "b_")) for j in range(len(PIVOTS))])
    near = F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= RADIUS
    compared = (left.join(right, (left["key"] == right["key"]) & (F.col("a_fp") < F.col("b_fp"))
                          & (apart <= RADIUS) & near)
                .select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")))
    crowded = shared.where(F.col("n") > CROWD).select("fp").distinct()
    steps = F.array(*[F.lit(_signed(1 << k)).cast("long") for k in range(BITS)], F.lit(0).cast("long"))
    around = crowded.select("fp", F.explode(steps).alias("step")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("step")).alias("reference"))
    met = around.groupBy("reference").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    chained = met.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a != b")
    return compared.union(chained).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`.

    Rows with equal fingerprints form one class before anything is compared.  A null or wordless
    text has fingerprint zero and is linked like any other; repeated rows are returned repeatedly; a
    null doc_id is never a component's id unless no row of the component has one.  Other columns of
    `docs` are not read.
    """
    rows = settled(fingerprints(docs, doc_id, text))
    classes = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(classes.select("fp")))
    labelled = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    named = labelled.join(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return rows.join(settled(named.select("fp", "component_id")), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row for each component: the row whose id names it.

    Rows without an id take no part and stay, and so does the first of several rows that repeat an
    id (by text).  All columns are kept as they are.
    """
    named = docs.where(F.col(doc_id).isNotNull())
    kept = near_duplicates(named, doc_id, text).select(F.col("component_id").alias("__kept")).distinct()
    order = F.row_number().over(Window.partitionBy("__kept").orderBy(F.col(text).asc_nulls_last()))
    out = named.join(kept, F.col(doc_id) == F.col("__kept")).withColumn("__copy", order).where("__copy = 1")
    return out.select(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))
