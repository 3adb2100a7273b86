"""Registered queries for aliasing and re-hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushspan.operators import alias as L
from hushspan.operators import scan as S
from hushspan.plans import oracle as O
from hushspan.plans.detection import TURN_CTES, turn_spans
from hushspan.sources.interim import materialize

CHUNK = 7


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with pattern spans, written once because aliasing reads them twice."""
    return materialize(turn_spans(spark, sf_dir))


def aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with vault aliases in their spans and the aliased text."""
    turns = detected(spark, sf_dir)
    return L.apply_vault(turns, L.mint_aliases(S.explode_spans(turns)))


_VAULT = ("scope_id", "kind", "raw_key", "n", "alias", "raw_sample")


def mint_aliases(spark, sf_dir):
    return L.mint_aliases(S.explode_spans(turn_spans(spark, sf_dir))).select(*_VAULT)


def mint_aliases_by_label(spark, sf_dir):
    vault = L.mint_aliases(S.explode_spans(turn_spans(spark, sf_dir)), counter_scope="label")
    return vault.select(*_VAULT)


def mint_aliases_incremental(spark, sf_dir):
    long = S.explode_spans(detected(spark, sf_dir))
    old = materialize(L.mint_aliases(long.filter("turn < 3")))
    return L.mint_aliases(long.filter("turn >= 3"), vault=old).select(*_VAULT)


def mint_per_request(spark, sf_dir):
    minted = L.mint_per_request(turn_spans(spark, sf_dir))
    return S.explode_spans(minted).select("msg_id", "start", "kind", "raw", "alias")


def alias_text(spark, sf_dir):
    return aliased(spark, sf_dir).select("msg_id", "text_aliased")


def mask_spans(spark, sf_dir):
    long = S.explode_spans(turn_spans(spark, sf_dir))
    return L.mask_spans(long).select("msg_id", "start", "shown")


def redact_kind(spark, sf_dir):
    return L.redact_kind(turn_spans(spark, sf_dir), "EMAIL").select("msg_id", "text_redacted")


def reverse_map(spark, sf_dir):
    return L.reverse_map(L.mint_per_request(turn_spans(spark, sf_dir)).select("msg_id", "spans"))


def rehydrate(spark, sf_dir):
    df = L.alias_text(L.mint_per_request(turn_spans(spark, sf_dir)))
    df = df.withColumn("response", F.concat(F.lit("Re: "), "text_aliased", F.lit(" ⟦open")))
    return L.rehydrate(df, "response").select("msg_id", "restored")


def response_chunks(df: DataFrame) -> DataFrame:
    """Aliased texts cut into small chunks with an end event, as a provider sends them."""
    last = f"cast(length(text_aliased) / {CHUNK} as int)"
    return df.select("msg_id", F.expr(
        f"explode(transform(sequence(0, {last} + 1), i -> named_struct('seq', i, 'event', "
        f"if(i <= {last}, 'Token', 'Done'), 'delta', if(i <= {last}, "
        f"substr(text_aliased, i * {CHUNK} + 1, {CHUNK}), '')))) as c")).select("msg_id", "c.*")


def chunked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = L.alias_text(L.mint_per_request(turn_spans(spark, sf_dir))).withColumn(
        "text_aliased", F.concat("text_aliased", F.lit(" ⟦tail")))
    df = materialize(df.select("conv_id", "turn", "msg_id", "spans", "text_aliased"))
    return response_chunks(df), df


def rehydrate_chunks(spark, sf_dir):
    chunks, df = chunked(spark, sf_dir)
    return L.rehydrate_chunks(chunks, df)


def alias_roundtrip_check(spark, sf_dir):
    df = L.mint_per_request(turn_spans(spark, sf_dir))
    return L.alias_roundtrip_check(df).select("msg_id", "ok")


def leak_filter(spark, sf_dir):
    df = L.alias_text(L.mint_per_request(turn_spans(spark, sf_dir)))
    payload = F.when(F.expr("turn % 2 = 0"), F.to_json(F.struct("msg_id", F.col("text_aliased").alias("note")))).otherwise(
        F.concat(F.lit('{"⟦key": "v", "id": "'), "msg_id", F.lit('"}')))
    return L.leak_filter(df.select("msg_id", payload.alias("payload"))).select("msg_id")


QUERIES = {
    "mint_aliases": mint_aliases, "mint_aliases_by_label": mint_aliases_by_label,
    "mint_aliases_incremental": mint_aliases_incremental, "mint_per_request": mint_per_request,
    "alias_text": alias_text, "mask_spans": mask_spans, "redact_kind": redact_kind,
    "reverse_map": reverse_map, "rehydrate": rehydrate, "rehydrate_chunks": rehydrate_chunks,
    "alias_roundtrip_check": alias_roundtrip_check, "leak_filter": leak_filter,
}

# ---- expected results in DuckDB ------------------------------------------------------------------


def token(kind: str, n: str) -> str:
    return f"concat('⟦', {O.label(kind)}, '_', CASE WHEN {n} < 10 THEN '0' ELSE '' END, {n}, '⟧')"


TSPANS = f"{TURN_CTES}, tspans AS MATERIALIZED (SELECT t.conv_id, t.turn, s.* FROM spans s JOIN turns t USING (msg_id))"


def vault_cte(source: str, scope: str, name: str = "vault", group: str = "kind", base: str = "0") -> str:
    return f"""
{name}_first AS (SELECT {scope} AS scope_id, kind, lower(raw) AS raw_key, turn, "start", raw, {O.label()} AS lab
  FROM {source} QUALIFY row_number() OVER (PARTITION BY {scope}, kind, lower(raw) ORDER BY turn, "start") = 1),
{name} AS MATERIALIZED (SELECT *, {token('kind', 'n')} AS alias FROM (
  SELECT scope_id, kind, raw_key, raw AS raw_sample, turn AS first_turn, row_number() OVER (
    PARTITION BY scope_id, {group} ORDER BY turn, "start") + {base} AS n FROM {name}_first))"""


def rewritten_cte(spans: str, texts: str, name: str = "rewritten", key: str = "msg_id") -> str:
    """Texts with spans (key, start, end, alias) replaced, put together from gaps and tokens."""
    return f"""
{name}_parts AS (SELECT {key}, "start", alias, coalesce(lag("end") OVER w, 0) AS prev, "end",
    row_number() OVER (PARTITION BY {key} ORDER BY "start" DESC) AS back FROM {spans}
  WINDOW w AS (PARTITION BY {key} ORDER BY "start")),
{name} AS MATERIALIZED (SELECT t.{key}, coalesce(string_agg(substr(t.text, p.prev + 1, p."start" - p.prev) || p.alias, ''
    ORDER BY p."start"), '') || substr(t.text, coalesce(max(p."end"), 0)::INT + 1) AS text_aliased
  FROM {texts} t LEFT JOIN {name}_parts p ON p.{key} = t.{key} GROUP BY t.{key}, t.text)"""


_VAULT_SQL = "scope_id, kind, raw_key, n, alias, raw_sample"
# Per-request numbering: the message is the scope.
LOCAL = f"""{TSPANS}, {vault_cte('tspans', 'msg_id', 'lv')},
aspans AS MATERIALIZED (SELECT s.*, v.alias FROM tspans s JOIN lv v ON v.scope_id = s.msg_id AND v.kind = s.kind
  AND v.raw_key = lower(s.raw)),
{rewritten_cte('aspans', 'turns')},
rev AS MATERIALIZED (SELECT msg_id, alias, raw FROM aspans QUALIFY row_number() OVER (
  PARTITION BY msg_id, alias ORDER BY "start" DESC) = 1),
revs AS MATERIALIZED (SELECT msg_id, list(concat(alias, chr(1), raw)) AS pairs FROM rev GROUP BY msg_id)"""


def restored(text: str, pairs: str) -> str:
    return (f"list_reduce(coalesce({pairs}, []::VARCHAR[]), lambda acc, p: replace(acc, split_part(p, chr(1), 1), "
            f"split_part(p, chr(1), 2)), {text})")


# What may be given out once the first characters are known: all, or up to the last open bracket.
_SAFE = (f"CASE WHEN contains(upto, '⟦') AND NOT contains(string_split(upto, '⟦')[-1], '⟧') "
         f"THEN length(upto) - length(string_split(upto, '⟦')[-1]) - 1 ELSE length(upto) END")
CHUNK_CTES = f"""{LOCAL},
full_text AS (SELECT msg_id, text_aliased || ' ⟦tail' AS t FROM rewritten),
pieces AS (SELECT msg_id, t, seq::INT AS seq, (length(t) // {CHUNK})::INT AS final FROM full_text,
  LATERAL (SELECT unnest(range(0, length(t) // {CHUNK} + 2)) AS seq)),
bounds AS (SELECT *, {_SAFE} AS bound FROM (SELECT *, left(t, (least(seq, final) + 1) * {CHUNK}) AS upto FROM pieces)),
cuts AS (SELECT *, coalesce(lag(bound) OVER (PARTITION BY msg_id ORDER BY seq), 0) AS prev FROM bounds),
emitted AS MATERIALIZED (SELECT c.msg_id, c.seq, c.seq > c.final AS done, CASE WHEN c.seq > c.final THEN substr(c.t, c.prev + 1)
    ELSE {restored('substr(c.t, c.prev + 1, c.bound - c.prev)', 'r.pairs')} END AS emitted
  FROM cuts c LEFT JOIN revs r USING (msg_id))"""

ALIASED = f"""{TSPANS}, {vault_cte('tspans', 'conv_id')},
aspans AS MATERIALIZED (SELECT s.*, v.alias FROM tspans s JOIN vault v ON v.scope_id = s.conv_id AND v.kind = s.kind
  AND v.raw_key = lower(s.raw)),
{rewritten_cte('aspans', 'turns')}"""

ORACLES = {
    "mint_aliases": f"WITH RECURSIVE {TSPANS}, {vault_cte('tspans', 'conv_id')} SELECT {_VAULT_SQL} FROM vault",
    "mint_aliases_by_label": f"WITH RECURSIVE {TSPANS}, {vault_cte('tspans', 'conv_id', group='lab')} SELECT {_VAULT_SQL} FROM vault",
    "mint_aliases_incremental": f"""
WITH RECURSIVE {TSPANS}, early AS (SELECT * FROM tspans WHERE turn < 3), {vault_cte('early', 'conv_id', 'old')},
late AS (SELECT * FROM tspans t WHERE turn >= 3 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.scope_id = t.conv_id
  AND o.kind = t.kind AND o.raw_key = lower(t.raw))),
{vault_cte('late', 'conv_id', 'fresh', base='(SELECT count(*) FROM old o WHERE o.scope_id = fresh_first.scope_id AND o.kind = fresh_first.kind)')}
SELECT {_VAULT_SQL} FROM fresh""",
    "mint_per_request": f'WITH RECURSIVE {LOCAL} SELECT msg_id, "start", kind, raw, alias FROM aspans',
    "alias_text": f"WITH RECURSIVE {ALIASED} SELECT * FROM rewritten",
    "mask_spans": f"""WITH RECURSIVE {TURN_CTES} SELECT msg_id, "start", repeat('•', least(length(raw), 10)) AS shown FROM spans""",
    "redact_kind": f"""
WITH RECURSIVE {TURN_CTES}, vals AS (SELECT msg_id, list(raw ORDER BY "start") AS raws FROM spans WHERE kind = 'EMAIL' GROUP BY 1)
SELECT t.msg_id, list_reduce(coalesce(v.raws, []::VARCHAR[]), lambda acc, r: replace(acc, r, '[REDACTED]'), t.text) AS text_redacted
FROM turns t LEFT JOIN vals v USING (msg_id)""",
    "reverse_map": f"WITH RECURSIVE {LOCAL} SELECT msg_id, alias, raw FROM rev",
    "rehydrate": f"""
WITH RECURSIVE {LOCAL} SELECT t.msg_id, {restored("concat('Re: ', t.text_aliased, ' ⟦open')", 'r.pairs')} AS restored
FROM rewritten t LEFT JOIN revs r USING (msg_id)""",
    "rehydrate_chunks": f"WITH RECURSIVE {CHUNK_CTES} SELECT msg_id, seq, CASE WHEN done THEN 'Done' ELSE 'Token' END AS event, emitted FROM emitted",
    "alias_roundtrip_check": f"""
WITH RECURSIVE {LOCAL} SELECT t.msg_id, {restored('a.text_aliased', 'r.pairs')} = t.text AS ok
FROM turns t JOIN rewritten a USING (msg_id) LEFT JOIN revs r USING (msg_id)""",
    "leak_filter": f"WITH RECURSIVE {LOCAL} SELECT msg_id FROM rewritten JOIN turns USING (msg_id) "
                   f"WHERE turn % 2 = 1 OR NOT regexp_matches(text_aliased, '[⟦⟧]')",
}
