"""Registered queries for the audit log and for traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushspan.operators import alias as L
from hushspan.operators import audit as U
from hushspan.operators import scan as S
from hushspan.operators import trace as T
from hushspan.operators.merge import detect_all
from hushspan.operators.policy import block_decision, route_model
from hushspan.plans import corpus as K
from hushspan.plans import oracle as O
from hushspan.plans.aliasing import CHUNK_CTES, LOCAL, TSPANS, chunked, rewritten_cte, vault_cte
from hushspan.plans.detection import TURN_CTES, WATCHLIST, merged_ctes, turn_spans
from hushspan.sources.interim import materialize

NOW = "2024-01-08 00:00:00"
# Time of a turn, and the number of an audit row; conv_id is 'c' and a number.
_SEC = "((cast(substr(conv_id, 2) AS BIGINT) * 977 + turn * 61) % 1209600)"


def _two(value: str) -> str:
    return f"lpad(concat('', cast(floor({value}) AS INT)), 2, '0')"


TS = (f"concat('2024-01-', {_two(f'{_SEC} / 86400 + 1')}, 'T', {_two(f'({_SEC} % 86400) / 3600')}, ':', "
      f"{_two(f'({_SEC} % 3600) / 60')}, ':', {_two(f'{_SEC} % 60')}, 'Z')")
SEQ = "cast(substr(conv_id, 2) AS BIGINT) * 1000000 + turn * 1000 + seq_in_msg"


def log(spark: SparkSession, sf_dir: str, mode: str = "send") -> DataFrame:
    """Audit rows of all turns, with conversation, turn and number."""
    df = block_decision(L.mint_per_request(turn_spans(spark, sf_dir))).withColumn("ts", F.expr(TS))
    rows = U.audit_rows(df, mode=mode)
    place = F.split(F.substring("msg_id", 2, 100), "-")
    return (rows.withColumn("conv_id", F.concat(F.lit("c"), place[0])).withColumn("turn", place[1].cast("bigint"))
            .withColumn("seq", F.expr(SEQ)))


def hash_raw(spark, sf_dir):
    long = S.explode_spans(turn_spans(spark, sf_dir))
    return long.select("msg_id", "start", U.hash_raw().alias("raw_hash"))


_ROW = ("msg_id", "ts", "seq_in_msg", "kind", "raw_hash", "alias", "action", "source")


def audit_rows(spark, sf_dir):
    return log(spark, sf_dir).select(*_ROW, "id")


def audit_rows_proxy(spark, sf_dir):
    return log(spark, sf_dir, "proxy").select(*_ROW)


def chain(spark, sf_dir) -> DataFrame:
    """Chains of a week's log, signed in two parts, the second going on from the first."""
    rows = materialize(log(spark, sf_dir))
    first = materialize(U.audit_chain(rows.filter("ts < '2024-01-08'"), "conv_id", shards=4))
    later = U.audit_chain(rows.filter("ts >= '2024-01-08'"), "conv_id", shards=4, heads=U.chain_heads(first))
    return first.unionByName(later)


def audit_chain(spark, sf_dir):
    return chain(spark, sf_dir).select("chain_id", "ts", "seq", "prev_hash", "sig")


def audit_verify(spark, sf_dir):
    changed = chain(spark, sf_dir).withColumn("alias", F.when(F.col("seq") % 7 == 3, F.lit("x")).otherwise(F.col("alias")))
    return U.audit_verify(changed.filter("seq % 11 <> 5")).select("chain_id", "seq", "sig_ok", "link_ok")


def audit_feed(spark, sf_dir):
    return U.audit_feed(log(spark, sf_dir)).select("ts", "seq", "kind", "alias", "action")


def _metrics(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return U.audit_metrics(rows, F.lit(NOW).cast("timestamp"))


def audit_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


def aliased_share(spark, sf_dir):
    return U.aliased_share(_metrics(spark, sf_dir)).select("redactions_7d", "blocks_7d", "aliased_share")


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = materialize(log(spark, sf_dir).withColumn(
        "uploaded_at", F.when(F.col("seq") % 5 == 0, F.lit(1_700_000_000)).cast("long")))
    ledger = rows.filter("seq % 3 = 0 AND uploaded_at IS NULL").select("id", F.lit(1_700_000_100).cast("long").alias("uploaded_at"))
    return rows, ledger


def pending_uploads(spark, sf_dir):
    rows, ledger = _stored(spark, sf_dir)
    return U.pending_uploads(rows, ledger).select("ts", "seq", "id")


def mark_uploaded(spark, sf_dir):
    rows, ledger = _stored(spark, sf_dir)
    return U.mark_uploaded(ledger, U.pending_uploads(rows, ledger), 1_700_000_200)


def export_batches(spark, sf_dir):
    rows, ledger = _stored(spark, sf_dir)
    bad = F.when(F.col("seq") % 13 == 0, F.lit("bad")).otherwise(F.col("ts"))
    return U.export_batches(U.pending(rows, ledger).withColumn("ts", bad))


def spans_by_kind(spark, sf_dir):
    counts = U.spans_by_kind(S.explode_spans(turn_spans(spark, sf_dir)), "conv_id")
    return counts.select("conv_id", "kind", "label", "spans", "total", "classes", "band")


# ---- traces ----------------------------------------------------------------------------------------
def pipeline_trace(spark, sf_dir):
    df = detect_all(K.turns(spark, sf_dir), watchlist=WATCHLIST, stages=True)
    df = L.alias_text(L.mint_per_request(df)).withColumn(
        "model_id", F.expr("CASE turn % 3 WHEN 0 THEN 'gpt-5' WHEN 1 THEN 'on-device' ELSE 'unknown' END"))
    return T.message_trace(route_model(df))


def _streams(spark, sf_dir):
    chunks, messages = chunked(spark, sf_dir)
    chunks = chunks.withColumn("at_ms", F.length("msg_id") * 10 + F.col("seq") * 3)
    return T.stream_trace(chunks, L.rehydrate_chunks(chunks, messages)), messages


def stream_trace(spark, sf_dir):
    return _streams(spark, sf_dir)[0]


def mean_ttft(spark, sf_dir):
    return T.mean_ttft(_streams(spark, sf_dir)[0])


def attach_late_trace(spark, sf_dir):
    streams, messages = _streams(spark, sf_dir)
    sent = messages.select("msg_id", F.size("spans").alias("n_spans"))
    late = messages.filter("turn % 2 = 1").select("msg_id", F.col("turn").alias("late_turn"))
    return T.attach_late_trace(sent, streams.filter("chunks > 60").select("msg_id", "ttft_ms", "chunks"), late)


def estimate_tokens(spark, sf_dir):
    return T.estimate_tokens(K.texts(spark, sf_dir)).select("doc_id", "tokens")


QUERIES = {
    "hash_raw": hash_raw, "audit_rows": audit_rows, "audit_rows_proxy": audit_rows_proxy, "audit_chain": audit_chain,
    "audit_verify": audit_verify, "audit_feed": audit_feed, "audit_metrics": audit_metrics,
    "pending_uploads": pending_uploads, "mark_uploaded": mark_uploaded, "export_batches": export_batches,
    "spans_by_kind": spans_by_kind, "aliased_share": aliased_share, "pipeline_trace": pipeline_trace,
    "stream_trace": stream_trace, "mean_ttft": mean_ttft, "attach_late_trace": attach_late_trace,
    "estimate_tokens": estimate_tokens,
}

# ---- expected results in DuckDB ------------------------------------------------------------------
_CRITICAL = f"""crit AS MATERIALIZED (SELECT msg_id, min("start") AS at FROM spans WHERE {O.critical()} GROUP BY msg_id)"""


def _log(source: str, chosen: str) -> str:
    return f"""{LOCAL}, {_CRITICAL},
audit AS MATERIALIZED (SELECT *, {SEQ} AS seq, sha256(concat_ws('|', msg_id, seq_in_msg, action)) AS id FROM (
  SELECT a.conv_id, a.turn, a.msg_id, {TS.replace('conv_id', 'a.conv_id').replace('turn', 'a.turn')} AS ts, (row_number() OVER (PARTITION BY a.msg_id
      ORDER BY a."start") - 1)::INT AS seq_in_msg, a.kind, sha256(a.raw) AS raw_hash, a.alias,
    CASE WHEN c.msg_id IS NULL THEN 'ALIAS' ELSE 'BLOCK' END AS action, '{source}' AS source
  FROM aspans a LEFT JOIN crit c USING (msg_id) WHERE c.msg_id IS NULL OR {chosen}))"""


AUDIT = _log("regex", 'a."start" = c.at')
_CHAIN = f"""{AUDIT},
queue AS MATERIALIZED (SELECT *, concat(conv_id, '/', seq % 4) AS chain_id, row_number() OVER (
  PARTITION BY conv_id, seq % 4 ORDER BY ts, seq) AS rn FROM audit),
signed AS (
  SELECT chain_id, rn, 'genesis' AS prev_hash, sha256(concat('genesis', ts, kind, raw_hash, alias, action)) AS sig FROM queue WHERE rn = 1
  UNION ALL
  SELECT q.chain_id, q.rn, s.sig, sha256(concat(s.sig, q.ts, q.kind, q.raw_hash, q.alias, q.action))
  FROM signed s JOIN queue q ON q.chain_id = s.chain_id AND q.rn = s.rn + 1),
chains AS MATERIALIZED (SELECT * FROM queue JOIN signed USING (chain_id, rn))"""
_WEEK = f"ts::TIMESTAMP >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY"
_COUNTS = f"""count(*) FILTER (WHERE action = 'ALIAS') AS redactions_total, count(*) FILTER (WHERE action = 'BLOCK') AS blocks_total,
  count(DISTINCT kind) AS classes, count(*) FILTER (WHERE action = 'ALIAS' AND ts::TIMESTAMP >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS redactions_24h,
  count(*) FILTER (WHERE action = 'ALIAS' AND {_WEEK}) AS redactions_7d, count(*) FILTER (WHERE action = 'BLOCK' AND {_WEEK}) AS blocks_7d"""
_PENDING = f"""{AUDIT}, pending AS MATERIALIZED (SELECT * FROM audit WHERE seq % 5 <> 0 AND seq % 3 <> 0),
batch AS (SELECT ts, seq, id FROM pending ORDER BY ts, seq LIMIT 200)"""
_TRACE = f"""{CHUNK_CTES},
streams AS MATERIALIZED (SELECT e.msg_id, (length(e.msg_id) * 10)::INT AS ttft_ms, max((length(e.msg_id) * 10 + e.seq * 3)::INT) AS total_stream_ms,
  count(*) FILTER (WHERE NOT e.done) AS chunks, any_value(strlen(f.t))::BIGINT AS bytes, any_value(f.t) AS response_aliased,
  string_agg(e.emitted, '' ORDER BY e.seq) AS response_restored, NULL::VARCHAR AS error
  FROM emitted e JOIN full_text f USING (msg_id) GROUP BY e.msg_id)"""

ORACLES = {
    "hash_raw": f'WITH RECURSIVE {TURN_CTES} SELECT msg_id, "start", sha256(raw) AS raw_hash FROM spans',
    "audit_rows": f"WITH RECURSIVE {AUDIT} SELECT {', '.join(_ROW)}, id FROM audit",
    "audit_rows_proxy": f"WITH RECURSIVE {_log('proxy', O.critical('a.kind'))} SELECT {', '.join(_ROW)} FROM audit",
    "audit_chain": f"WITH RECURSIVE {_CHAIN} SELECT chain_id, ts, seq, prev_hash, sig FROM chains",
    "audit_verify": f"""
WITH RECURSIVE {_CHAIN}, changed AS (SELECT * REPLACE (CASE WHEN seq % 7 = 3 THEN 'x' ELSE alias END AS alias) FROM chains WHERE seq % 11 <> 5)
SELECT chain_id, seq, sig = sha256(concat(prev_hash, ts, kind, raw_hash, alias, action)) AS sig_ok,
  prev_hash = coalesce(lag(sig) OVER (PARTITION BY chain_id ORDER BY ts, seq), 'genesis') AS link_ok FROM changed""",
    "audit_feed": f"WITH RECURSIVE {AUDIT} SELECT ts, seq, kind, alias, action FROM audit ORDER BY ts DESC, seq DESC LIMIT 50",
    "audit_metrics": f"WITH RECURSIVE {AUDIT} SELECT {_COUNTS} FROM audit",
    "aliased_share": f"""
WITH RECURSIVE {AUDIT}, m AS (SELECT {_COUNTS} FROM audit) SELECT redactions_7d, blocks_7d, CASE WHEN redactions_7d + blocks_7d = 0
  THEN 100 ELSE floor(redactions_7d * 100.0::DOUBLE / (redactions_7d + blocks_7d) + 0.5) END::INT AS aliased_share FROM m""",
    "pending_uploads": f"WITH RECURSIVE {_PENDING} SELECT * FROM batch",
    "mark_uploaded": f"""
WITH RECURSIVE {_PENDING} SELECT id, 1700000100 AS uploaded_at FROM audit WHERE seq % 3 = 0 AND seq % 5 <> 0
UNION ALL SELECT id, 1700000200 FROM batch""",
    "export_batches": f"""
WITH RECURSIVE {_PENDING}, timed AS (SELECT *, CASE WHEN seq % 13 = 0 THEN 0 ELSE epoch(ts::TIMESTAMP)::BIGINT END AS unix FROM pending),
placed AS (SELECT *, row_number() OVER (ORDER BY unix, seq) AS rn FROM timed)
SELECT (rn - 1) // 200 AS batch, count(*) AS n, concat('[', string_agg(concat('{{"ts":', unix, ',"kind":"', kind, '","source":"', source,
  '","action":"', action, '","raw_hash":"', raw_hash, '","alias":"', alias, '"}}'), ',' ORDER BY rn), ']') AS events FROM placed GROUP BY 1""",
    "spans_by_kind": f"""
WITH RECURSIVE {TSPANS}, k AS (SELECT conv_id, kind, count(*) AS spans, max({O.confidence()}) AS confidence FROM tspans GROUP BY ALL)
SELECT conv_id, kind, {O.label()} AS label, spans, (sum(spans) OVER (PARTITION BY conv_id))::BIGINT AS total, count(*) OVER (PARTITION BY conv_id) AS classes,
  CASE WHEN confidence >= 0.95::FLOAT THEN 'high' WHEN confidence >= 0.85::FLOAT THEN 'medium' ELSE 'low' END AS band FROM k""",
    "pipeline_trace": f"""
WITH RECURSIVE texts AS MATERIALIZED (SELECT msg_id AS doc_id, turn, text FROM ({K.turns_sql(K.DUCKDB)})), {merged_ctes('texts')},
{vault_cte('(SELECT *, 0 AS turn FROM merged)', 'doc_id', 'lv')},
aspans AS MATERIALIZED (SELECT s.*, v.alias FROM merged s JOIN lv v ON v.scope_id = s.doc_id AND v.kind = s.kind AND v.raw_key = lower(s.raw)),
{rewritten_cte('aspans', 'texts', key='doc_id')},
counted AS (SELECT doc_id, count(*) FILTER (WHERE stage = 'p') AS p, count(*) FILTER (WHERE stage = 's') AS s, count(*) FILTER (WHERE stage = 'w') AS w,
  count(*) FILTER (WHERE stage = 'm') AS m, arg_min(kind, "start") FILTER (WHERE stage = 'm' AND {O.critical()}) AS blocked FROM (
  SELECT doc_id, 'p' AS stage, kind, "start" FROM l1 UNION ALL SELECT doc_id, 's', kind, "start" FROM structured
  UNION ALL SELECT doc_id, 'w', kind, "start" FROM watch UNION ALL SELECT doc_id, 'm', kind, "start" FROM merged) GROUP BY doc_id)
SELECT t.doc_id AS msg_id, strlen(t.text)::INT AS text_len, coalesce(p, 0)::INT AS pattern_spans, coalesce(s, 0)::INT AS structured_spans,
  coalesce(w, 0)::INT AS watchlist_spans, coalesce(m, 0)::INT AS merged_spans, 0 AS model_spans,
  CASE t.turn % 3 WHEN 0 THEN 'gpt-5' WHEN 1 THEN 'on-device' ELSE 'unknown' END AS model_id,
  CASE t.turn % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'local' END AS provider, 'not_loaded' AS detector_status, c.blocked AS blocked_kind, r.text_aliased
FROM texts t LEFT JOIN counted c USING (doc_id) JOIN rewritten r USING (doc_id)""",
    "stream_trace": f"WITH RECURSIVE {_TRACE} SELECT * FROM streams",
    "mean_ttft": f"WITH RECURSIVE {_TRACE} SELECT floor(avg(ttft_ms) + 0.5)::BIGINT AS mean_ttft_ms FROM streams",
    "attach_late_trace": f"""
WITH RECURSIVE {_TRACE}, n AS (SELECT msg_id, count(*) AS n FROM aspans GROUP BY msg_id)
SELECT t.msg_id, coalesce(n.n, 0)::INT AS n_spans, s.ttft_ms, s.chunks, CASE WHEN t.turn % 2 = 1 THEN t.turn END AS late_turn
FROM turns t LEFT JOIN n USING (msg_id) LEFT JOIN (SELECT * FROM streams WHERE chunks > 60) s USING (msg_id)""",
    "estimate_tokens": f"SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM ({K.texts_sql(K.DUCKDB)})",
}
