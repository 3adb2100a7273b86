"""Registered queries for egress policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushspan.kinds import BLOCK_POLICY
from hushspan.operators import alias as L
from hushspan.operators import policy as P
from hushspan.operators import scan as S
from hushspan.operators.merge import detect_all
from hushspan.plans import corpus as K
from hushspan.plans import oracle as O
from hushspan.plans.aliasing import ALIASED, TSPANS, detected, rewritten_cte, vault_cte
from hushspan.plans.detection import TURN_CTES, turn_spans

MODELS = ["gpt-5", "claude-haiku", "ollama:llama3", "on-device", "mystery-1", "openrouter:x/y"]
_BASE_URLS = "CASE turn % 3 WHEN 0 THEN 'http://localhost:11434' WHEN 1 THEN 'http://10.0.0.5:11434' ELSE 'https://127.0.0.1/v1' END"

EVENT_MODELS = """
SELECT event_id, CASE event_id % 14 WHEN 0 THEN 'gpt-5' WHEN 1 THEN 'gpt-5-mini' WHEN 2 THEN 'o4' WHEN 3 THEN 'claude-opus-4'
  WHEN 4 THEN 'claude-sonnet' WHEN 5 THEN 'claude-haiku' WHEN 6 THEN 'gemini-2-5-pro' WHEN 7 THEN 'gemini-flash' WHEN 8 THEN 'grok-4'
  WHEN 9 THEN concat('openrouter:', event_type, '/m') WHEN 10 THEN concat('ollama:', event_type) WHEN 11 THEN 'on-device'
  WHEN 12 THEN concat('gpt-', event_type) ELSE '' END AS model_id FROM events"""

URLS = """
SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'http://localhost:11434' WHEN 1 THEN 'localhost' WHEN 2 THEN 'http://127.0.0.1:80/x?y'
  WHEN 3 THEN 'http://[::1]:11434/' WHEN 4 THEN 'http://user:pw@localhost:1/' WHEN 5 THEN 'http://localhost.evil.com/'
  WHEN 6 THEN 'http://evil.com/@localhost' WHEN 7 THEN 'http://localhost@evil.com:11434' WHEN 8 THEN '' WHEN 9 THEN 'http://evil.com#localhost'
  ELSE url END AS base_url FROM pages"""

_Q = "chr(34)"
# Chat content as JSON: a text, or a list of parts of which only those with a text count.
CHAT = f"""
SELECT conv_id AS request_id, turn, CASE WHEN turn % 4 = 3 THEN 'tool' ELSE role END AS role,
  CASE WHEN turn % 3 = 1 THEN concat('[{{"type":"text","text":"part ', turn, '"}},{{"type":"image"}},{{"type":"text","text":"of ', role, '"}}]')
       WHEN turn % 5 = 4 THEN concat({_Q}, {_Q})
       ELSE concat({_Q}, replace(replace(text, {_Q}, concat(chr(92), {_Q})), chr(10), concat(chr(92), 'n')), ' mail u', turn, '@example.com', {_Q}) END AS content
FROM conversations"""


def block_decision(spark, sf_dir):
    return P.block_decision(turn_spans(spark, sf_dir)).select("msg_id", "blocked", "blocked_kind")


def block_policy(spark, sf_dir):
    df = P.block_policy(P.block_decision(turn_spans(spark, sf_dir)))
    return df.select("msg_id", "blocked_kind", "rule", "class", "description")


def route_model(spark, sf_dir):
    K.load(spark, sf_dir, "events")
    return P.route_model(spark.sql(EVENT_MODELS))


def classify_endpoint(spark, sf_dir):
    K.load(spark, sf_dir, "pages")
    return P.classify_endpoint(spark.sql(URLS))


def egress_payload(spark, sf_dir):
    models = ", ".join(f"'{m}'" for m in MODELS)
    df = detected(spark, sf_dir).withColumn("base_url", F.expr(_BASE_URLS)).withColumn(
        "model_id", F.expr(f"element_at(array({models}), cast((length(text) + turn) % {len(MODELS)} as int) + 1)"))
    decided = P.egress_decision(df)
    # A blocked turn uses up no alias numbers: it leaves before anything is minted.
    sent = decided.filter("NOT blocked").select("msg_id", "conv_id", "turn", "text", "spans", "model_id", "base_url")
    vault = L.mint_aliases(S.explode_spans(sent))
    out = ("msg_id", "model_id", "blocked_kind", "egress", "payload")
    held = decided.filter("blocked").withColumn("payload", F.lit(None).cast("string"))
    return P.egress_payload(L.apply_vault(sent, vault)).select(*out).unionByName(held.select(*out))


def _chat(spark, sf_dir):
    K.load(spark, sf_dir, "conversations")
    return P.flatten_messages(spark.sql(CHAT))


def flatten_messages(spark, sf_dir):
    return _chat(spark, sf_dir)


def prepare_payload(spark, sf_dir):
    df = P.prepare_payload(detect_all(_chat(spark, sf_dir)))
    return df.select("request_id", "text_aliased", F.size("spans").alias("n_spans"), "blocked_kind", "class")


def fan_out(spark, sf_dir):
    # A turn uses up alias numbers if any of its destinations takes it.
    turns = detected(spark, sf_dir).withColumn("base_url", F.expr(_BASE_URLS))
    leaving = P.egress_decision(P.fan_out(turns, MODELS)).filter("NOT blocked").select("msg_id").distinct()
    minted = S.explode_spans(turns.join(leaving, "msg_id", "left_semi"))
    df = L.apply_vault(turns, L.mint_aliases(minted))
    sent = P.egress_payload(P.fan_out(df, MODELS))
    return sent.select("msg_id", "model_no", "model_id", "provider", "egress", "payload")


QUERIES = {
    "block_decision": block_decision, "block_policy": block_policy, "route_model": route_model,
    "classify_endpoint": classify_endpoint, "egress_payload": egress_payload,
    "flatten_messages": flatten_messages, "prepare_payload": prepare_payload, "fan_out": fan_out,
}

# ---- expected results in DuckDB ------------------------------------------------------------------
BLOCKED = f"""blocked AS MATERIALIZED (SELECT msg_id, arg_min(kind, "start") AS blocked_kind FROM spans
  WHERE {O.critical()} GROUP BY msg_id)"""


def _policy(i: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {O.q(v[i])}" for k, v in BLOCK_POLICY.items())
    return f"CASE blocked_kind {whens} END"


_PROVIDER = """CASE WHEN model_id = 'on-device' THEN 'local' WHEN model_id LIKE 'openrouter:%' THEN 'openrouter'
  WHEN model_id LIKE 'ollama:%' THEN 'ollama' WHEN model_id IN ('gpt-5', 'gpt-5-mini', 'o4') THEN 'openai'
  WHEN model_id IN ('claude-opus-4', 'claude-sonnet', 'claude-haiku') THEN 'anthropic'
  WHEN model_id IN ('gemini-2-5-pro', 'gemini-flash') THEN 'google' WHEN model_id = 'grok-4' THEN 'xai' END"""
_EGRESS = f"""
sent AS (SELECT *, {_PROVIDER} AS provider, model_id = 'on-device' OR (model_id LIKE 'ollama:%' AND turn % 3 <> 1) AS is_local FROM pairs),
decided AS (SELECT *, CASE WHEN is_local THEN 'sent_raw' WHEN blocked_kind IS NOT NULL THEN 'blocked'
  WHEN provider IS NOT NULL THEN 'sent_aliased' ELSE 'no_provider' END AS egress FROM sent)"""
_PAYLOAD = "CASE egress WHEN 'sent_raw' THEN text WHEN 'sent_aliased' THEN text_aliased END"
_HOST = r"""regexp_extract(regexp_replace(regexp_extract(regexp_replace(base_url, '^.*?://', ''), '^[^/?#]*'), '^.*@', ''),
  '^\[?([^\]:]*(?:::1)?)', 1)"""
_FLAT = """
flat AS MATERIALIZED (SELECT request_id, rtrim(string_agg(concat(who, ': ', c), chr(10) || chr(10) ORDER BY turn), E' \\n\\t\\r') AS text
  FROM (SELECT conv_id AS request_id, turn, CASE WHEN turn % 4 = 3 THEN 'User' WHEN role = 'system' THEN 'System'
      WHEN role = 'assistant' THEN 'Assistant' ELSE 'User' END AS who,
    CASE WHEN turn % 3 = 1 THEN concat('part ', turn, chr(10), 'of ', role) WHEN turn % 5 = 4 THEN ''
      ELSE concat(text, ' mail u', turn, '@example.com') END AS c FROM conversations) WHERE c <> '' GROUP BY request_id)"""

ORACLES = {
    "block_decision": f"WITH RECURSIVE {TURN_CTES}, {BLOCKED} SELECT t.msg_id, blocked_kind IS NOT NULL AS blocked, blocked_kind "
                      f"FROM turns t LEFT JOIN blocked USING (msg_id)",
    "block_policy": f"WITH RECURSIVE {TURN_CTES}, {BLOCKED} SELECT t.msg_id, blocked_kind, {_policy(0)} AS rule, {_policy(1)} AS class, "
                    f"{_policy(2)} AS description FROM turns t LEFT JOIN blocked USING (msg_id)",
    "route_model": f"SELECT *, provider IS NOT NULL AS routable FROM (SELECT *, {_PROVIDER} AS provider FROM ({EVENT_MODELS}))",
    "classify_endpoint": f"SELECT *, {_HOST} IN ('localhost', '127.0.0.1', '::1') AS is_local FROM ({URLS})",
    "egress_payload": f"""
WITH RECURSIVE {TSPANS}, {BLOCKED}, pairs AS (SELECT t.*, b.blocked_kind,
  {MODELS!r}[((length(t.text) + t.turn) % {len(MODELS)})::INT + 1] AS model_id
  FROM turns t LEFT JOIN blocked b USING (msg_id)), {_EGRESS},
stay AS MATERIALIZED (SELECT s.* FROM tspans s JOIN decided d USING (msg_id) WHERE d.egress <> 'blocked'), {vault_cte('stay', 'conv_id')},
aspans AS MATERIALIZED (SELECT s.*, v.alias FROM stay s JOIN vault v ON v.scope_id = s.conv_id AND v.kind = s.kind
  AND v.raw_key = lower(s.raw)),
{rewritten_cte('aspans', 'turns')}
SELECT msg_id, model_id, CASE WHEN egress = 'blocked' THEN blocked_kind END AS blocked_kind, egress, {_PAYLOAD} AS payload FROM decided JOIN rewritten USING (msg_id)""",
    "flatten_messages": f"WITH {_FLAT} SELECT * FROM flat",
    "prepare_payload": f"""
WITH RECURSIVE {_FLAT}, {O.hits_ctes('flat', 'request_id')}, {O.spans_ctes('request_id')},
numbered AS (SELECT *, 0 AS turn FROM spans), {vault_cte('numbered', 'request_id')},
aspans AS (SELECT s.*, v.alias FROM numbered s JOIN vault v ON v.scope_id = s.request_id AND v.kind = s.kind AND v.raw_key = lower(s.raw)),
{rewritten_cte('aspans', 'flat', key='request_id')},
found AS (SELECT request_id, count(*) AS n, arg_min(kind, "start") FILTER (WHERE {O.critical()}) AS blocked_kind FROM spans GROUP BY 1)
SELECT request_id, text_aliased, coalesce(n, 0)::INT AS n_spans, blocked_kind, {_policy(1)} AS class
FROM rewritten LEFT JOIN found USING (request_id)""",
    "fan_out": f"""
WITH RECURSIVE {ALIASED}, {BLOCKED}, pairs AS (SELECT t.*, a.text_aliased, b.blocked_kind, m.i::INT AS model_no, {MODELS!r}[m.i + 1] AS model_id
  FROM turns t JOIN rewritten a USING (msg_id) LEFT JOIN blocked b USING (msg_id), range(0, {len(MODELS)}) m(i)), {_EGRESS}
SELECT msg_id, model_no, model_id, provider, egress, {_PAYLOAD} AS payload FROM decided""",
}
