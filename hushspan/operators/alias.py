"""Stable alias tokens: minting, rewriting, masking and putting the real values back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.functions import arrays as A
from hushspan.kinds import SPANS_TYPE, label_sql
from hushspan.operators.ranking import running_total
from hushspan.operators.scan import computed, explode_array

# The token's brackets, the redaction mark and the mask.
LEFT, RIGHT = "⟦", "⟧"
REDACTED, MASK, MASK_WIDTH = "[REDACTED]", "•", 10

# Turns per numbering piece; see ranking.running_total.
TURNS_PER_PIECE = 1024


def token_sql(kind: str, number: str) -> str:
    """Alias token; numbers below 100 have two digits (lpad would cut longer ones)."""
    digits = f"if({number} < 10, concat('0', {number}), cast({number} as string))"
    return f"concat('{LEFT}', {label_sql(kind)}, '_', {digits}, '{RIGHT}')"


def mint_aliases(spans: DataFrame, scope: str = "conv_id", turn: str = "turn",
                 counter_scope: str = "kind", vault: DataFrame | None = None) -> DataFrame:
    """Alias vault rows for a long span table (scope, turn, start, kind, raw).

    A value is (kind, lower-case raw).  Its number is its place among the first appearances in the
    scope, counted per kind, or per label with `counter_scope="label"`, which keeps two values from
    sharing a token.  With a `vault`, known values are left out and numbering goes on from it.

    The first aggregation runs map-side, so only distinct values are shuffled and numbered.
    """
    first = (spans
             .select(F.col(scope).alias("scope_id"), "kind", F.lower("raw").alias("raw_key"),
                     F.struct(F.col(turn).cast("long").alias("turn"), F.col("start").alias("start"),
                              F.col("raw").alias("raw")).alias("at"))
             .groupBy("scope_id", "kind", "raw_key").agg(F.min("at").alias("at")))
    base = None
    counter = "kind" if counter_scope == "kind" else "__label"
    if vault is not None:
        first = first.join(vault.select("scope_id", "kind", "raw_key"),
                           ["scope_id", "kind", "raw_key"], "left_anti")
        base = (vault.withColumn("__label", F.expr(label_sql("kind")))
                .groupBy("scope_id", counter).agg(F.max("n").alias("n")))
    rows = first.select("scope_id", "kind", "raw_key", "at.turn", "at.start",
                        F.col("at.raw").alias("raw_sample"), F.expr(label_sql("kind")).alias("__label"))
    numbered = running_total(
        rows, ["scope_id", counter], ["turn", "start", "kind", "raw_key"],
        F.floor(F.col("turn") / TURNS_PER_PIECE), base=base)
    return numbered.select("scope_id", "kind", "raw_key", "n", F.expr(token_sql("kind", "n")).alias("alias"),
                           "raw_sample", F.col("turn").alias("first_turn"))


def alias_local_sql(spans: str) -> str:
    """Spans with aliases from a fresh scope of their own: numbering inside one row, no shuffle."""
    s, d, i, x = A.name("s"), A.name("d"), A.name("i"), A.name("x")

    def with_keys(keys: str) -> str:
        place = f"array_position({d}, struct({s}.kind, lower({s}.raw)))"
        number = (f"size(filter(slice({d}, 1, cast({place} as int)), {x} -> {x}.kind = {s}.kind))")
        return (f"get(transform(array(array_distinct({keys})), {d} -> transform({spans}, {s} -> "
                f"named_struct('start', {s}.start, 'end', {s}.end, 'kind', {s}.kind, 'raw', {s}.raw,"
                f" 'alias', {token_sql(f'{s}.kind', number)}, 'confidence', {s}.confidence))), 0)")
    return with_keys(f"transform({spans}, {i} -> struct({i}.kind as kind, lower({i}.raw) as col2))")


def mint_per_request(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Fill in aliases that hold inside one request only."""
    return computed(df, spans, alias_local_sql(spans))


def rewrite_sql(text: str, spans: str) -> str:
    """Text with every span replaced by its alias."""
    s, i = A.name("s"), A.name("i")
    before = f"coalesce(get({spans}, {i} - 1).end, 0)"
    pieces = (f"transform({spans}, ({s}, {i}) -> concat(substr({text}, {before} + 1, "
              f"{s}.start - {before}), {s}.alias))")
    return (f"concat(array_join({pieces}, ''), "
            f"substr({text}, coalesce(get({spans}, size({spans}) - 1).end, 0) + 1))")


def alias_text(df: DataFrame, text: str = "text", spans: str = "spans",
               out: str = "text_aliased") -> DataFrame:
    return computed(df, out, rewrite_sql(text, spans))


def apply_vault(messages: DataFrame, vault: DataFrame, msg: str = "msg_id", scope: str = "conv_id",
                text: str = "text") -> DataFrame:
    """Put vault aliases into the messages' spans and rewrite the text.

    The join is on (scope, kind, value), which spreads a busy scope over its values.  The text takes
    no part in it and is shuffled once, for the join on the message id.  A value that the vault does
    not know is replaced by the redaction mark, so that nothing raw is left over.
    """
    long = explode_array(messages.select(msg, F.col(scope).alias("scope_id"), "spans"), "spans")
    long = long.drop("alias").withColumn("raw_key", F.lower("raw"))
    found = long.join(vault.select("scope_id", "kind", "raw_key", "alias"), ["scope_id", "kind", "raw_key"], "left")
    found = found.withColumn("alias", F.coalesce("alias", F.lit(REDACTED)))
    span = F.struct("start", "end", "kind", "raw", "alias", "confidence")
    lists = found.groupBy(msg).agg(F.sort_array(F.collect_list(span)).cast(SPANS_TYPE).alias("spans"))
    joined = (messages.drop("spans").join(lists, msg, "left")
              .withColumn("spans", F.expr(f"coalesce(spans, cast(array() as {SPANS_TYPE}))")))
    return alias_text(joined, text)


def mask_spans(long_spans: DataFrame, mode: str = "mask", out: str = "shown") -> DataFrame:
    """What a viewer sees for a span: a mask, the alias, or the raw value."""
    shown = {"mask": F.expr(f"repeat('{MASK}', least(length(raw), {MASK_WIDTH}))"),
             "alias": F.col("alias"), "raw": F.col("raw")}[mode]
    return long_spans.withColumn(out, shown)


def redact_kind(df: DataFrame, kind: str, text: str = "text", spans: str = "spans",
                out: str = "text_redacted") -> DataFrame:
    """Replace every occurrence of each value of one kind."""
    s, acc = A.name("s"), A.name("acc")
    values = f"transform(filter({spans}, {s} -> {s}.kind = '{kind}'), {s} -> {s}.raw)"
    return df.withColumn(out, F.expr(
        f"aggregate({values}, {text}, ({acc}, {s}) -> replace({acc}, {s}, '{REDACTED}'))"))


def reverse_sql(spans: str) -> str:
    """array<struct<alias, raw>> of a message; the last span with an alias decides, case is kept."""
    s, a = A.name("s"), A.name("a")
    last = f"element_at(filter({spans}, {s} -> {s}.alias = {a}), -1).raw"
    return (f"transform(array_distinct(transform({spans}, {s} -> {s}.alias)), {a} -> "
            f"named_struct('alias', {a}, 'raw', {last}))")


def reverse_map(df: DataFrame, spans: str = "spans") -> DataFrame:
    """One row per alias of each message, with its raw value."""
    keep = [c for c in df.columns if c not in (spans, "text", "text_aliased")]
    return explode_array(df.select(*keep, F.expr(reverse_sql(spans)).alias("__map")), "__map")


def restore_sql(text: str, reverse: str) -> str:
    acc, e = A.name("acc"), A.name("e")
    return f"aggregate({reverse}, {text}, ({acc}, {e}) -> replace({acc}, {e}.alias, {e}.raw))"


def rehydrate(df: DataFrame, response: str, spans: str = "spans", out: str = "restored") -> DataFrame:
    """Put real values back into a response that stands in the same row as its message's spans."""
    return df.withColumn(out, F.expr(A.let(reverse_sql(spans), lambda r: restore_sql(response, r))))


def held_back_sql(text: str) -> str:
    """Tail that may be the start of a token: from the last opening bracket not yet closed."""
    tail = f"substring_index({text}, '{LEFT}', -1)"
    return (f"if(contains({text}, '{LEFT}') AND NOT contains({tail}, '{RIGHT}'), "
            f"concat('{LEFT}', {tail}), '')")


def rehydrate_chunks(chunks: DataFrame, messages: DataFrame, msg: str = "msg_id") -> DataFrame:
    """Restore ordered chunks (msg, seq, event, delta): one row per chunk with the text given out.

    A chunk that ends inside a token gives out only what stands before it; `Done` gives out the rest
    as it is.  The group is one response, whose text is one value anyway.
    """
    chunk = F.struct(F.col("seq").cast("int").alias("seq"), "event", "delta")
    lists = chunks.groupBy(msg).agg(F.sort_array(F.collect_list(chunk)).alias("__chunks"))
    reverse = messages.select(msg, F.expr(reverse_sql("spans")).alias("__reverse"))
    joined = lists.join(reverse, msg, "left")

    def step(buffer: str, c: str) -> tuple[str, str]:
        joined_text = f"concat({buffer}, {c}.delta)"
        held = held_back_sql(joined_text)
        safe = f"left({joined_text}, length({joined_text}) - length({held}))"
        restored = f"if(__reverse IS NULL, {safe}, {restore_sql(safe, '__reverse')})"
        emitted = (f"CASE {c}.event WHEN 'Token' THEN {restored} WHEN 'Done' THEN {buffer} ELSE '' END")
        return (f"CASE {c}.event WHEN 'Token' THEN {held} ELSE '' END",
                f"array(named_struct('seq', {c}.seq, 'event', {c}.event, 'emitted', {emitted}))")
    out = A.running("__chunks", "''", step, "struct<seq:int,event:string,emitted:string>")
    return explode_array(joined.select(msg, F.expr(out).alias("__out")), "__out")


def alias_roundtrip_check(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add `restored` and `ok`: does putting the values back give the text again?"""
    df = alias_text(df, text, spans)
    return rehydrate(df, "text_aliased", spans).withColumn("ok", F.col("restored") == F.col(text))


def leak_filter(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Drop rows whose JSON values hold an alias bracket; keys are not looked at."""
    values = f"regexp_replace({payload}, {A.lit(r'\"(?:[^\"\\]|\\.)*+\"\s*:')}, '')"
    marked = f"({values} rlike {A.lit(rf'[{LEFT}{RIGHT}]|\\u27[eE][67]')})"
    clean = f"NOT (contains({payload}, '{LEFT}') OR contains({payload}, '{RIGHT}') OR {payload} rlike {A.lit(r'\\u27[eE][67]')})"
    return df.filter(F.expr(f"{clean} OR NOT {marked}"))
