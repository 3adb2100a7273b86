"""Detection quality: span scores, critical misses, gates and comparisons.

`actual` and `expected` are long tables (prompt_id, kind, raw).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushspan.kinds import CRITICAL_KINDS, sql_map

# ---- Fixed values: gates and the other tool's names ----------------------------------------------
GATES = {"fast": (0.80, 200, True), "full": (0.75, 3000, False)}  # precision, p99 ms, blocks
EXTERNAL_KINDS = {
    "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "US_SSN": "SSN", "IP_ADDRESS": "IP",
    "URL": "URL", "PERSON": "PERSON_NER", "LOCATION": "LOCATION_NER", "ORGANIZATION": "ORG_NER",
}
# ---- end of the fixed values -----------------------------------------------------------------------


def kind_class(kind: str = "kind") -> Column:
    """Organisation and code name count as one class."""
    return F.when(F.col(kind).isin("ORG_NER", "CODENAME_NER"), "ORG_OR_CODENAME").otherwise(F.col(kind))


def _counts(df: DataFrame, keys: list, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def _matched(actual: DataFrame, expected: DataFrame, keys: list) -> DataFrame:
    """Multiset match per key: both sides are counted before they meet."""
    both = _counts(actual, keys, "a").join(_counts(expected, keys, "e"), keys, "full_outer")
    both = both.na.fill(0, ["a", "e"])
    tp = F.least("a", "e")
    return both.select(*keys, tp.alias("tp"), (F.col("a") - tp).alias("fp"), (F.col("e") - tp).alias("fn"))


def _with_class(df: DataFrame) -> DataFrame:
    return df.withColumn("class", kind_class())


def score_spans(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """TP, FP and FN per prompt; each expected span is used once."""
    hits = _matched(_with_class(actual), _with_class(expected), ["prompt_id", "class", "raw"])
    return hits.groupBy("prompt_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def critical_misses(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected blocking spans without any equal actual span; repeats count each time."""
    wanted = expected.filter(F.col("kind").isin(*CRITICAL_KINDS))
    found = actual.filter(F.col("kind").isin(*CRITICAL_KINDS)).select("prompt_id", "kind", "raw").distinct()
    return wanted.join(found, ["prompt_id", "kind", "raw"], "left_anti").select("prompt_id", "kind", "raw")


def precision_recall_f1(df: DataFrame) -> DataFrame:
    """Add precision, recall and F1 to rows with tp, fp, fn."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    p = F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, F.lit(1.0)).otherwise(tp / (tp + fn))
    df = df.withColumn("precision", p).withColumn("recall", r)
    total = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(total == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / total))


def latency_summary(latencies: DataFrame, ms: str = "ms", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and nearest-rank p95 / p99 (index floor(n*q) of the sorted values, whole milliseconds).

    Values are counted first, so only distinct milliseconds reach the ordered step.
    """
    by = list(by) or ["__all"]
    latencies = latencies.withColumn(ms, F.col(ms).cast("long"))
    rows = latencies.withColumn("__all", F.lit(1)) if by == ["__all"] else latencies
    histogram = rows.groupBy(*by, ms).agg(F.count("*").alias("c"))
    order = W.partitionBy(*by).orderBy(ms).rowsBetween(W.unboundedPreceding, 0)
    ranked = (histogram.withColumn("upto", F.sum("c").over(order))
              .withColumn("n", F.sum("c").over(W.partitionBy(*by))))

    def percentile(q: float) -> Column:
        index = F.least(F.floor(F.col("n") * q), F.col("n") - 1)
        return F.min(F.when(F.col("upto") > index, F.col(ms)))
    out = ranked.groupBy(*by).agg(
        F.max("n").alias("n"), (F.sum(F.col(ms) * F.col("c")) / F.max("n")).alias("avg_ms"),
        percentile(0.95).alias("p95_ms"), percentile(0.99).alias("p99_ms"))
    return out.drop("__all")


def quality_gates(totals: DataFrame, mode: str = "fast") -> DataFrame:
    """One row (precision, p99_ms, critical_missed) to its gate results."""
    precision, p99, blocks = GATES[mode]
    failed = (F.col("critical_missed") > 0) | (F.col("precision") < precision) | (F.col("p99_ms") > p99)
    return (totals.withColumn("mode", F.lit(mode))
            .withColumn("misses_ok", F.col("critical_missed") == 0)
            .withColumn("precision_ok", F.col("precision") >= precision)
            .withColumn("p99_ok", F.col("p99_ms") <= p99)
            .withColumn("passed", ~failed)
            .withColumn("exit_code", F.when(failed & F.lit(blocks), 1).otherwise(0)))


def compare_configs(actual: DataFrame, expected: DataFrame, configs: list[str]) -> DataFrame:
    """Metrics per configuration and kind; matching stays inside a kind.

    `actual` also has `config`.  Every expected span counts for every configuration.
    """
    all_configs = F.array(*[F.lit(c) for c in configs])
    wanted = expected.select("*", F.explode(all_configs).alias("config"))
    hits = _matched(actual, wanted, ["config", "prompt_id", "kind", "raw"])
    per_kind = hits.groupBy("config", "kind").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return precision_recall_f1(per_kind)


def compare_totals(per_kind: DataFrame, latencies: DataFrame) -> DataFrame:
    """Metrics of each configuration over all kinds, with its latencies (config, ms)."""
    totals = per_kind.groupBy("config").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return precision_recall_f1(totals).join(latency_summary(latencies, by=("config",)).drop("n"), "config", "left")


def compare_table(actual: DataFrame, expected: DataFrame, configs: list[str]) -> DataFrame:
    """One row for each kind, and one for `all`, with the metrics of every configuration side by side.

    Kinds and totals are grouping sets of one pass over the matched spans; columns are named
    `<config>_tp` and so on.  A configuration without a kind has nulls there.
    """
    all_configs = F.array(*[F.lit(c) for c in configs])
    wanted = expected.select("*", F.explode(all_configs).alias("config"))
    hits = _matched(actual, wanted, ["config", "prompt_id", "kind", "raw"])
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    sets = hits.groupingSets([["config", "kind"], ["config"]], "config", "kind").agg(F.grouping("kind").alias("whole"), *sums)
    scores = precision_recall_f1(sets).withColumn("kind", F.when(F.col("whole") == 1, F.lit("all")).otherwise(F.col("kind")))
    metrics = ("tp", "fp", "fn", "precision", "recall", "f1")
    return scores.groupBy("kind").pivot("config", configs).agg(*[F.max(m).alias(m) for m in metrics])


def map_external_kinds(df: DataFrame, entity: str = "entity_type") -> DataFrame:
    """Another tool's entity names in our kinds; names without one are dropped."""
    mapped = df.withColumn("kind", F.expr(sql_map(entity, EXTERNAL_KINDS)))
    return mapped.filter(F.col("kind").isNotNull())


def error_listing(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per false positive and false negative.

    Only the difference of the two counts is written out, so equal copies are never numbered.  Within
    a class, copies keep their own kind: matched ones are taken from the start of the kinds' order.
    """
    keys = ["prompt_id", "class", "raw"]

    def surplus(df: DataFrame, other: DataFrame, error: str) -> DataFrame:
        mine = _counts(_with_class(df), [*keys, "kind"], "c")
        matched = _counts(_with_class(other), keys, "m")
        # At most the two kinds of one class meet here.
        upto = W.partitionBy(*keys).orderBy("kind").rowsBetween(W.unboundedPreceding, 0)
        joined = mine.withColumn("upto", F.sum("c").over(upto)).join(matched, keys, "left").na.fill(0, ["m"])
        left = F.least(F.col("c"), F.greatest(F.col("upto") - F.col("m"), F.lit(0)))
        rows = joined.withColumn("left", left).filter("left > 0")
        return rows.select("prompt_id", F.lit(error).alias("error"), "kind", "raw",
                           F.expr("explode(array_repeat(1, cast(left as int)))").alias("one")).drop("one")
    return surplus(actual, expected, "FP").unionByName(surplus(expected, actual, "FN"))
