"""Running totals and numbering inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], order: list[str], bucket: Column,
                  value: Column | None = None, out: str = "n",
                  base: DataFrame | None = None, levels: tuple[int, ...] = ()) -> DataFrame:
    """Add the running sum of `value` (1 by default, so a row number) over `keys` in `order`.

    `bucket` must rise with `order`; it cuts a group into pieces.  Pieces are numbered on their own
    and shifted by the total of the pieces before them, so a key that holds a third of all rows is
    spread over its pieces.  Only one row per (key, bucket) goes through the window over whole keys;
    with `levels` the pieces are summed in the same way, in runs of levels[0] buckets, those in runs of
    levels[1] runs and so on, so that no window sees more than one run.
    `base` (keys, n) holds totals that come before the first piece.
    """
    piece, worth, inside, offset = (f"__{name}{len(levels)}" for name in ("piece", "value", "inside", "offset"))
    value = F.lit(1) if value is None else value
    df = df.withColumn(piece, bucket.cast("long")).withColumn(worth, value.cast("long"))
    total = f"__total{len(levels)}"
    pieces = df.groupBy(*keys, piece).agg(F.sum(worth).alias(total))
    if levels:
        summed = running_total(pieces, keys, [piece], F.floor(F.col(piece) / levels[0]), F.col(total), "__upto", base, levels[1:])
        offsets = summed.select(*keys, piece, (F.col("__upto") - F.col(total)).alias(offset))
    else:
        if base is not None:
            pieces = pieces.unionByName(base.select(
                *keys, F.lit(-(2**62)).cast("long").alias(piece), F.col("n").cast("long").alias(total)))
        before = W.partitionBy(*keys).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
        offsets = pieces.select(*keys, piece, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(offset))
    within = W.partitionBy(*keys, piece).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    numbered = df.withColumn(inside, F.sum(worth).over(within))
    return (numbered.join(offsets, [*keys, piece])
            .withColumn(out, (F.col(inside) + F.col(offset)).cast("long"))
            .drop(piece, worth, inside, offset))
