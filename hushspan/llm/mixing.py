"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushspan.llm.common import id_text, settled

WEIGHTS = (5, 2, 1)
#: The hash of a document has LEVELS digits of DIGIT bits; a histogram has 2^DIGIT bins a source.
DIGIT, LEVELS = 15, 4
#: Most sources whose budgets are sent to every executor (some 100 bytes each); more are joined.
BROADCAST_SOURCES = 50_000


def words(text: str) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(doc_id: str) -> Column:
    """60 bits of the id's MD5: the order in which a source's documents are taken."""
    return F.conv(F.substring(F.md5(id_text(doc_id).cast("binary")), 1, 15), 16, 10).cast("long")


def _source_key(source: str) -> Column:
    """The source as a text that is never null and keeps code point order, null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def targets(sizes: DataFrame) -> DataFrame:
    """(k, source_size, target, base, twice_rest) of each source, from rows (k, size).

    150 % of all sizes are shared by weight; a source takes twice its size at most and the excess is
    shared again.  In the order of size over weight the sources at their limit come first, so one
    pass of running sums finds them; all comparisons are between whole numbers.  `base` is how often
    every document of the source is taken and `twice_rest` double what is left for part of them.
    One row for each source goes through these windows, never a document.
    """
    sums = sizes.groupBy("k").agg(F.sum("size").alias("source_size"))
    weights = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    ranked = sums.withColumn("w", F.element_at(
        weights, ((F.row_number().over(W.orderBy("k")) - 1) % len(WEIGHTS) + 1).cast("int")))
    order = W.orderBy(F.col("source_size") / F.col("w"), "k")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    ranked = (ranked
              .withColumn("left2", 3 * F.sum("source_size").over(everything)
                          - 4 * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
              .withColumn("left_w", F.sum("w").over(after))
              .withColumn("full", 4 * F.col("source_size") * F.col("left_w") <= F.col("w") * F.col("left2")))
    open2 = F.max(F.when(~F.col("full"), F.col("left2"))).over(everything)
    open_w = F.max(F.when(~F.col("full"), F.col("left_w"))).over(everything)
    share = (F.col("w") * open2).cast("double") / (2 * open_w).cast("double")
    full = F.col("full") | (F.col("source_size") == 0)
    return (ranked
            .withColumn("target", F.when(full, (2 * F.col("source_size")).cast("double")).otherwise(share))
            .withColumn("base", F.when(full, F.lit(2)).otherwise(
                F.floor(F.col("target") / F.col("source_size"))).cast("long"))
            .withColumn("twice_rest", 2 * (F.col("target") - F.col("base") * F.col("source_size")))
            .select("k", "source_size", "target", "base", "twice_rest"))


def thresholds(rows: DataFrame) -> DataFrame:
    """(k, source_size, target, base, last) from rows (k, h, size).

    Documents with hash up to `last` are taken once more than `base`.  A histogram of tokens by
    source and leading digit of the hash finds the bin in which the budget ends; the rows of that bin
    alone are counted again by the next digit, down to one hash, which is taken if the sum comes
    nearer to the target with it.  No documents are sorted.
    """
    goals = settled(targets(rows.select("k", "size")))
    open_ = goals.select("k", "twice_rest", F.lit(0).cast("long").alias("below"))
    inside = rows.select("k", "h", "size")
    for level in range(1, LEVELS + 1):
        shift = DIGIT * (LEVELS - level)
        bins = inside.groupBy("k", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("in_bin"))
        upto = F.sum("in_bin").over(W.partitionBy("k").orderBy("bin"))
        counted = bins.withColumn("upto", upto).join(open_, "k").withColumn("upto", F.col("upto") + F.col("below"))
        passing = counted.where(2 * F.col("upto") > F.col("twice_rest"))
        edge = settled(passing.groupBy("k").agg(
            F.min(F.struct("bin", "in_bin", "upto", "twice_rest")).alias("e")).select("k", "e.*"))
        if level == LEVELS:
            break
        open_ = edge.select("k", "twice_rest", (F.col("upto") - F.col("in_bin")).alias("below"))
        inside = settled(inside.withColumn("bin", F.shiftright("h", shift))
                         .join(edge.select("k", "bin"), ["k", "bin"]).select("k", "h", "size"))
    near = 2 * F.col("upto") - F.col("in_bin") <= F.col("twice_rest")
    found = edge.select("k", F.when(near, F.col("bin")).otherwise(F.col("bin") - 1).alias("last"))
    return goals.join(found, "k", "left").withColumn("last", F.coalesce("last", F.lit((1 << 62) - 1))).drop("twice_rest")


def _with_budgets(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Rows with their source's budget; a hot source is not shuffled while the budgets are few."""
    few = budgets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(budgets) if few else budgets, "k")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of `docs`.

    A document is taken 0, 1 or 2 times as a whole.  Null and empty texts have size 0; a null source
    is a source of its own, after all others; rows with equal ids, null included, share a hash and
    are taken alike.  Other columns are not read.  An empty table gives an empty result.
    """
    rows = settled(docs.select(F.col(doc_id).alias("doc_id"), _source_key(source).alias("k"),
                               _hash(doc_id).alias("h"), words(text).alias("size")))
    again = (F.col("h") <= F.col("last")).cast("long")
    return _with_budgets(rows, settled(thresholds(rows))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("base") + again)).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with all its columns."""
    narrow = settled(docs.select(_source_key(source).alias("k"), _hash(doc_id).alias("h"), words(text).alias("size")))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    by_name = dict(zip(docs.columns, names))
    rows = rows.withColumn("k", _source_key(by_name[source])).withColumn("h", _hash(by_name[doc_id]))
    # A document without words weighs nothing, so any threshold would take it once more than twice.
    times = F.least(F.col("base") + (F.col("h") <= F.col("last")).cast("long"), F.lit(2))
    out = _with_budgets(rows, settled(thresholds(narrow))).withColumn(
        "time", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int")))).where(times >= 1)
    return out.select(*[F.col(n).alias(c) for c, n in by_name.items()])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (
                  ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left2,
                sum(w) OVER (ORDER BY source_size / w, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM w),
f AS (SELECT *, 4 * source_size * left_w <= w * left2 AS full_ FROM o),
g AS (SELECT source, source_size, CASE WHEN full_ OR source_size = 0 THEN (2 * source_size)::DOUBLE
             ELSE (w * max(CASE WHEN NOT full_ THEN left2 END) OVER ())::DOUBLE
                  / (2 * max(CASE WHEN NOT full_ THEN left_w END) OVER ())::DOUBLE END AS target,
             full_ OR source_size = 0 AS full_ FROM f),
b AS (SELECT *, CASE WHEN full_ THEN 2 ELSE floor(target / source_size) END::BIGINT AS base FROM g),
h AS (SELECT source, h, sum(size) AS in_h FROM d GROUP BY source, h),
c AS (SELECT source, h, sum(in_h) OVER (PARTITION BY source ORDER BY h) AS upto, in_h FROM h)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.base + CASE WHEN 2 * c.upto - c.in_h <= 2 * (b.target - b.base * b.source_size)
                           THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
       JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
