"""Pattern detection: rule scans, overlap resolution and the detector built from both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.functions import arrays as A
from hushspan.functions.checks import is_valid
from hushspan.functions.rules import CLOSE, OPEN, RULES
from hushspan.functions.textscan import hit_lists
from hushspan.kinds import KINDS, SPAN_TYPE, confidence_sql

# Sort key first: start ascending, longer first, then rule order.
HIT_TYPE = "struct<start:int,neg_len:int,ord:int,kind:string,raw:string>"
_CLEAN, _FOUND = "__clean", "__found"


def computed(df: DataFrame, out: str, expression: str) -> DataFrame:
    """Add (or replace) `out`, kept apart from the steps that follow.

    The one-element `inline_outer` puts a Generate node between the expression and its uses.  Without
    it the optimizer copies the whole expression, with all rules in it, into every filter and every
    projection that names the column.
    """
    keep = [c for c in df.columns if c != out]
    return df.select(*keep, F.expr(f"inline_outer(array(named_struct('{out}', {expression})))"))


def rules_of(packs=None) -> list[tuple[int, object]]:
    """Numbered rules of the given packs (all packs by default)."""
    return [(i, r) for i, r in enumerate(RULES, 1) if packs is None or KINDS[r.kind][1] in packs]


def with_scan_columns(df: DataFrame, text: str) -> DataFrame:
    """A helper column for patterns that mark what they find.

    `__clean` has the two marker characters, and the two dotted/dotless i's that Java folds to "i"
    but the rules do not, replaced by another letter of the same length, so offsets hold.
    """
    odd = OPEN + CLOSE + "İı"
    any_odd = " OR ".join(f"contains({text}, '{c}')" for c in odd)
    return df.withColumn(_CLEAN, F.expr(
        f"CASE WHEN {any_odd} THEN translate({text}, '{odd}', '\uf8ff\uf8ffŀŀ')"
        f" ELSE {text} END"))


def with_hits(df: DataFrame, text: str, packs=None, out: str = _FOUND) -> DataFrame:
    """Add the hits of all rules of the packs as array<HIT_TYPE>, unordered and not yet checked.

    Only the text goes to the Python worker, whole and once for all rules.
    """
    numbers = tuple(i for i, _ in rules_of(packs))
    found = F.arrow_udf(lambda texts: hit_lists(texts, numbers), f"array<{HIT_TYPE}>")
    return df.withColumn(out, found(F.col(text)))


def hits_sql(found: str = _FOUND, packs=None) -> str:
    """The hits of column `found` whose values pass the checks of their kinds."""
    hit = A.name("h")
    valid = is_valid(f"{hit}.kind", f"{hit}.raw", {r.kind for _, r in rules_of(packs)})
    return f"filter({found}, {hit} -> {valid})"


def resolve_sql(hits: str) -> str:
    """Greedy left-to-right choice among hits; the result is array<SPAN_TYPE> ordered by start."""
    def step(cursor: str, h: str) -> tuple[str, str]:
        keep = f"{h}.start >= {cursor}"
        span = (f"named_struct('start', {h}.start, 'end', {h}.start - {h}.neg_len,"
                f" 'kind', {h}.kind, 'raw', {h}.raw, 'alias', '',"
                f" 'confidence', {confidence_sql(f'{h}.kind')})")
        return (f"if({keep}, {h}.start - {h}.neg_len, {cursor})",
                f"if({keep}, array({span}), cast(array() as array<{SPAN_TYPE}>))")
    return A.running(f"sort_array({hits})", "-1", step, SPAN_TYPE)


def detect_patterns(df: DataFrame, text: str = "text", out: str = "spans", packs=None) -> DataFrame:
    """Add `out`, the resolved pattern spans of `text`.  One narrow pass, no shuffle."""
    df = with_hits(df, text, packs)
    found = f"coalesce({resolve_sql(hits_sql(packs=packs))}, cast(array() as array<{SPAN_TYPE}>))"
    return computed(df, out, found).drop(_FOUND)


def explode_array(df: DataFrame, column: str) -> DataFrame:
    """One row per struct of an array column.

    The outer form plus a filter on the struct gives the rows of `inline`, but keeps Spark from inferring a
    `size(column) > 0` filter, which it would push below the projection and so run the whole
    detection a second time.
    """
    keep = [c for c in df.columns if c != column]
    rows = df.select(*keep, F.expr(f"explode_outer({column}) as __item"))
    return rows.filter(F.col("__item").isNotNull()).select(*keep, "__item.*")


def scan_pack(df: DataFrame, packs, text: str = "text") -> DataFrame:
    """One row per validated hit of the packs' rules, before overlaps are resolved."""
    keep = [c for c in df.columns if c != text]
    df = with_hits(df, text, packs)
    df = explode_array(df.select(*keep, F.expr(hits_sql(packs=packs)).alias("__hits")), "__hits")
    return df.select(
        *keep, "start", (F.col("start") - F.col("neg_len")).alias("end"), "kind", "raw",
        F.col("ord").alias("rule_no"), F.expr(confidence_sql("kind")).alias("confidence"))


def resolve_overlaps(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Resolve a long table of hits (doc, start, end, kind, raw, rule_no) to one span list per doc.

    The group is the hits of one document, which its text bounds.
    """
    hit = F.struct(
        F.col("start").cast("int").alias("start"),
        (F.col("start") - F.col("end")).cast("int").alias("neg_len"),
        F.col("rule_no").cast("int").alias("ord"), "kind", "raw")
    return (df.groupBy(doc).agg(F.collect_list(hit).alias("__hits"))
            .select(doc, F.expr(resolve_sql("__hits")).alias("spans")))


def explode_spans(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Long form: one row per span, without the span list and without the text."""
    return explode_array(df.drop("text"), spans)


def with_byte_offsets(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace character offsets by UTF-8 byte offsets."""
    s = A.name("s")
    moved = (f"named_struct('start', octet_length(substr({text}, 1, {s}.start)),"
             f" 'end', octet_length(substr({text}, 1, {s}.end)), 'kind', {s}.kind, 'raw', {s}.raw,"
             f" 'alias', {s}.alias, 'confidence', {s}.confidence)")
    return df.withColumn(spans, F.expr(f"transform({spans}, {s} -> {moved})"))
