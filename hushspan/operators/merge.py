"""Putting span lists together: precedence merge, pack filter, annotation, full detection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushspan.functions import arrays as A
from hushspan.kinds import (MODEL_KINDS, SPAN_TYPE, SPANS_TYPE, TOGGLEABLE_PACKS, label_sql,
                            pack_sql, sql_list)
from hushspan.operators.ranking import running_total
from hushspan.operators.scan import _CLEAN, _FOUND, computed, hits_sql, resolve_sql, with_hits, with_scan_columns
from hushspan.operators.structured import structured_sql
from hushspan.operators.watchlist import clean_terms, watchlist_sql


def merge_sql(primary: str, secondary: str) -> str:
    """`primary` plus each span of `secondary` that overlaps nothing taken so far, by start.

    Two sweeps over all spans in order of their starts, one from each end, leave the secondary spans
    that no primary span overlaps.  Only if some of those overlap each other does their order in the
    list decide, and they are taken one by one.
    """
    item = f"struct<start:int,rank:int,at:int,span:{SPAN_TYPE}>"
    none = f"cast(array() as array<{item}>)"
    s, i, acc, a, free = (A.name(n) for n in ("s", "i", "acc", "a", "free"))

    def tagged(spans: str, rank: int) -> str:
        return (f"transform({spans}, ({s}, {i}) -> named_struct('start', {s}.start, 'rank', {rank}, "
                f"'at', {i}, 'span', {s}))")

    def from_left(upto: str, x: str) -> tuple[str, str]:
        return (f"if({x}.rank = 0, greatest({upto}, {x}.span.end), {upto})",
                f"if({x}.rank = 0 OR {x}.start >= {upto}, array({x}), {none})")

    def from_right(first: str, x: str) -> tuple[str, str]:
        return (f"if({x}.rank = 0, least({first}, {x}.start), {first})",
                f"if({x}.rank = 1 AND {x}.span.end <= {first}, array({x}), {none})")
    both = f"sort_array(concat({tagged(primary, 0)}, {tagged(secondary, 1)}))"
    right = A.running(f"reverse({A.running(both, '-1', from_left, item)})", str(2**31 - 1), from_right, item)
    alone = (f"NOT exists(sequence(1, greatest(size({free}) - 1, 1)), {i} -> coalesce("
             f"get({free}, {i}).span.end > get({free}, {i} - 1).start, false))")
    chosen = (f"aggregate(sort_array(transform({free}, {a} -> named_struct('at', {a}.at, 'span', {a}.span))), "
              f"cast(array() as {SPANS_TYPE}), ({acc}, {s}) -> if(exists({acc}, {a} -> {a}.start < {s}.span.end "
              f"AND {s}.span.start < {a}.end), {acc}, array_append({acc}, {s}.span)))")
    merged = (f"get(transform(array({right}), {free} -> sort_array(concat({primary}, "
              f"if({alone}, transform({free}, {a} -> {a}.span), {chosen})))), 0)")
    return f"if(size({secondary}) = 0, {primary}, {merged})"


def merge_spans(df: DataFrame, primary: str, secondary: str, out: str = "spans") -> DataFrame:
    """Merge two span-list columns of the same row; the first wins on overlap."""
    return computed(df, out, merge_sql(primary, secondary))


def merge_span_tables(primary: DataFrame, secondary: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Merge two long span tables (doc, span columns) into one list per document.

    One shuffle on the document; its span lists are bounded by its text.
    """
    def listed(df: DataFrame, name: str) -> DataFrame:
        span = F.struct("start", "end", "kind", "raw", "alias", "confidence")
        return df.groupBy(doc).agg(F.sort_array(F.collect_list(span)).cast(SPANS_TYPE).alias(name))
    empty = f"cast(array() as {SPANS_TYPE})"
    both = listed(primary, "__p").join(listed(secondary, "__s"), doc, "full_outer")
    both = both.select(doc, F.expr(f"coalesce(__p, {empty})").alias("__p"),
                       F.expr(f"coalesce(__s, {empty})").alias("__s"))
    return both.select(doc, F.expr(merge_sql("__p", "__s")).alias("spans"))


#: Characters of a text that meet in one group of `merge_span_rows`.
BUCKET = 4096
_COLUMNS = ("start", "end", "kind", "raw", "alias", "confidence")


def merge_span_rows(primary: DataFrame, secondary: DataFrame, doc: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """Merge two long span tables (doc, span columns) into one, as `merge_span_tables` does, for dense tables.

    No list of a text's spans is gathered.  The secondary spans that a primary one overlaps are found
    by a range join on (doc, bucket of characters), where a span stands in each bucket that it touches.
    The others are taken from the left unless they overlap one that was taken; places that none of them
    passes over cut a text into runs, which are numbered by two levels of sums, sorted (which may
    spill) and walked with nothing but the end of the last span taken.
    """
    first, second = (t.select(doc, *_COLUMNS) for t in (primary, secondary))
    touched = F.sequence(F.floor(F.col("start") / bucket), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / bucket))
    p = first.select(F.col(doc).alias("__d"), F.explode(touched).alias("__b"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    places = second.select(doc, "start", "end").distinct()
    s = places.withColumn("__b", F.explode(touched))
    hit = s.join(p, (F.col(doc) == F.col("__d")) & (s["__b"] == p["__b"]) & (F.col("__s") < F.col("end")) & (F.col("start") < F.col("__e")),
                 "left_semi").select(doc, "start", "end").distinct()
    free = second.join(hit, [doc, "start", "end"], "left_anti")
    # The farthest end before each span: inside its bucket, and in the buckets before it.
    at = free.withColumn("__b", F.floor(F.col("start") / bucket))
    buckets = at.groupBy(doc, "__b").agg(F.max("end").alias("__far"))
    earlier = W.partitionBy(doc).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.select(doc, "__b", F.max("__far").over(earlier).alias("__before"))
    inside = W.partitionBy(doc, "__b").orderBy(*_COLUMNS).rowsBetween(W.unboundedPreceding, -1)
    far = F.greatest(F.max("end").over(inside), F.col("__before"))
    opened = at.join(buckets, [doc, "__b"]).withColumn("__new", F.when(F.col("start") < far, 0).otherwise(1))
    runs = running_total(opened, [doc], list(_COLUMNS), F.col("__b"), F.col("__new"), "__run").drop("__b", "__before", "__new")
    fields = ", ".join(f"{n} {runs.schema[n].dataType.simpleString()}" for n in (doc, *_COLUMNS))
    walked = runs.select(doc, *_COLUMNS, "__run").repartition(doc, "__run").sortWithinPartitions(doc, "__run", *_COLUMNS)
    return first.unionByName(walked.mapInArrow(_take_from_left, fields))


def _take_from_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted spans (doc, start, end, ..., run) those that start behind the last one taken of their run."""
    run, upto = object(), 0
    for batch in batches:
        kept = []
        for i, (doc, start, end, number) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, batch.num_columns - 1)))):
            if (doc, number) != run:
                run, upto = (doc, number), start
            if start >= upto:
                kept.append(i)
                upto = max(upto, end)
        out = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays(out.columns[:-1], out.schema.names[:-1])


def sanitise_packs(packs) -> list[str]:
    """Only packs that may be switched off at all."""
    return [p for p in packs or () if p in TOGGLEABLE_PACKS]


def filter_packs_sql(spans: str, disabled) -> str:
    off = sanitise_packs(disabled)
    if not off:
        return spans
    s = A.name("s")
    return f"filter({spans}, {s} -> NOT {pack_sql(f'{s}.kind')} IN ({sql_list(off)}))"


def filter_packs(df: DataFrame, disabled, spans: str = "spans") -> DataFrame:
    return df.withColumn(spans, F.expr(filter_packs_sql(spans, disabled)))


def annotate_spans(long_spans: DataFrame) -> DataFrame:
    """Add label, pack, confidence tier and source to a long span table."""
    return (long_spans
            .withColumn("label", F.expr(label_sql("kind")))
            .withColumn("pack", F.expr(pack_sql("kind")))
            .withColumn("tier", F.expr(confidence_tier_sql("confidence")))
            .withColumn("source", F.expr(source_sql("kind"))))


def source_sql(kind: str) -> str:
    return f"if({kind} IN ({sql_list(MODEL_KINDS)}), 'ner', 'regex')"


def confidence_tier_sql(confidence: str) -> str:
    return (f"CASE WHEN {confidence} >= cast(0.95 as float) THEN 'high' "
            f"WHEN {confidence} >= cast(0.85 as float) THEN 'medium' ELSE 'low' END")


def detect_all(df: DataFrame, text: str = "text", out: str = "spans", watchlist=None,
               disabled_packs=(), model_spans: str | None = None, stages: bool = False) -> DataFrame:
    """Patterns, structured cells, watchlist and model spans, merged in that precedence.

    All of it works on one row at a time, so the job is a single stage without a shuffle.  With
    `stages` the lists before the merge are kept as `<out>_pattern`, `_structured`, `_watchlist`.
    """
    columns = [c for c in df.columns if c != out]
    empty = f"cast(array() as {SPANS_TYPE})"
    df = with_hits(with_scan_columns(df, text), text)
    lists = {
        "pattern": filter_packs_sql(resolve_sql(hits_sql()), disabled_packs),
        "structured": filter_packs_sql(structured_sql(text), disabled_packs),
        "watchlist": watchlist_sql(clean_terms(watchlist), text),
    }
    named = [f"{out}_{k}" for k in lists]
    for name, found in zip(named, lists.values()):
        df = computed(df, name, f"coalesce({found}, {empty})")
    df = df.drop(_CLEAN, _FOUND)
    merged = f"{out}_pattern"
    for step in ([f"{out}_structured"] + ([f"{out}_watchlist"] if watchlist else [])
                 + ([model_spans] if model_spans else [])):
        df = computed(df, f"__m_{step}", merge_sql(merged, step))
        merged = f"__m_{step}"
    kept = named if stages else []
    return df.select(*columns, *kept, F.col(merged).alias(out))
