"""Registered queries for stored tables and for streams; both go through files in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushspan.kinds import SPANS_TYPE, TOGGLEABLE_PACKS, sql_list
from hushspan.operators import alias as L
from hushspan.operators import scan as S
from hushspan.operators.merge import merge_span_rows, merge_span_tables
from hushspan.operators.policy import block_decision
from hushspan.plans import corpus as K
from hushspan.plans import oracle as O
from hushspan.plans.aliasing import ALIASED, CHUNK_CTES, TSPANS, aliased, chunked, detected
from hushspan.plans.audits import AUDIT, TS, log
from hushspan.plans.audits import ORACLES as AUDIT_ORACLES
from hushspan.plans.detection import TURN_CTES, _ANSWER_SPANS, answers, merged_ctes, turn_spans
from hushspan.plans.policies import BLOCKED
from hushspan.plans.quality import EXPECTED, PROMPTS
from hushspan.session import shared_dir
from hushspan.sources import store
from hushspan.sources.interim import materialize
from hushspan.streaming import jobs

CREATED = "concat('2024-01-', lpad(concat('', 1 + cast(substr(conv_id, 2) AS BIGINT) % 28), 2, '0'), 'T00:00:', lpad(concat('', turn), 2, '0'))"
SETTINGS = """
SELECT event_id AS seq, concat(CASE event_id % 3 WHEN 0 THEN 'custom_watchlist' WHEN 1 THEN 'disabled_packs' ELSE event_type END) AS key,
  concat('u', user_id) AS owner, CASE event_id % 3
  WHEN 0 THEN CASE WHEN event_id % 5 = 0 THEN 'not json' ELSE concat('["term ', user_id, '","', event_type, '"]') END
  WHEN 1 THEN CASE WHEN event_id % 4 = 0 THEN '["payment","identity"' ELSE '["payment","identity","secrets","network","nothing"]' END
  ELSE props END AS value FROM events"""


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/hushspan-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the turns as written messages."""
    folder = new_folder(spark)
    df = aliased(spark, sf_dir).withColumn("created_at", F.expr(CREATED)).withColumnRenamed("text", "text_raw")
    store.write_messages(df, folder)
    return folder


def write_messages(spark, sf_dir):
    rows = spark.read.parquet(stored(spark, sf_dir))
    return rows.select("msg_id", "conv_id", "role", "text_raw", "text_aliased", "created_at")


def read_messages(spark, sf_dir):
    rows = spark.read.parquet(stored(spark, sf_dir))
    one = store.read_messages(rows, "c3").select("msg_id", "created_at", F.lit(True).alias("asked"))
    return store.read_messages(rows).select("msg_id", "created_at", F.lit(False).alias("asked")).unionByName(one)


def list_conversations(spark, sf_dir):
    rows = spark.read.parquet(stored(spark, sf_dir))
    conversations = rows.groupBy(F.col("conv_id").alias("id")).agg(F.max("created_at").alias("created_at"))
    return store.list_conversations(conversations, rows)


def load_spans_json(spark, sf_dir):
    rows = spark.read.parquet(stored(spark, sf_dir))
    broken = F.expr("CASE WHEN length(msg_id) % 2 = 0 THEN replace(spans_json, '\"confidence\":', '\"c\":') "
                    "WHEN contains(msg_id, '7') THEN left(spans_json, length(spans_json) - 1) ELSE spans_json END")
    spans = S.explode_spans(store.load_spans_json(rows.select("msg_id", broken.alias("spans_json"))).drop("spans_json"))
    return spans.select("msg_id", "start", "end", "kind", "raw", "confidence")


def read_eval_corpus(spark, sf_dir):
    K.load(spark, sf_dir, "orders")
    folder = new_folder(spark)
    expected = spark.sql(EXPECTED).groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct("kind", "raw"))).alias("expected"))
    prompts = spark.sql(PROMPTS).join(expected, "prompt_id")
    prompt = F.struct(F.concat(F.lit("p"), "prompt_id").alias("id"), "text", "expected",
                      F.when(F.col("prompt_id") % 2 == 0, True).alias("semantic_only"))
    (prompts.select(F.lit(1).alias("version"), F.array(prompt).alias("prompts")).write.json(folder))
    read = store.read_eval_corpus(spark, folder)
    kinds = F.expr("array_join(transform(expected, e -> concat(e.kind, '=', e.raw)), ' ')")
    return read.select("id", "text", kinds.alias("expected"), "semantic_only", "note")


def _settings(spark, sf_dir) -> DataFrame:
    K.load(spark, sf_dir, "events")
    return spark.sql(SETTINGS)


def latest_settings(spark, sf_dir):
    changes = _settings(spark, sf_dir).withColumn("key", F.concat_ws("/", "owner", "key"))
    return store.latest_settings(changes).select("key", "value")


def read_watchlist(spark, sf_dir):
    return store.read_watchlist(_settings(spark, sf_dir)).select("seq", "owner", "item")


def read_disabled_packs(spark, sf_dir):
    return store.read_disabled_packs(_settings(spark, sf_dir)).select("seq", "owner", "item")


def _elsewhere(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pattern spans of the turns, and a table of spans from elsewhere."""
    turns = turn_spans(spark, sf_dir)
    first = S.explode_spans(turns)
    second = turns.select("msg_id", F.expr("inline(transform(sequence(0, 5), k -> named_struct('start', cast(turn * 7 + k * 11 as int), "
                                           "'end', cast(turn * 7 + k * 11 + 8 as int), 'kind', 'ORG_NER', 'raw', concat('w', k), 'alias', '', "
                                           "'confidence', cast(0.6 as float))))"))
    return first, second


def merge_tables(spark, sf_dir):
    merged = merge_span_tables(*_elsewhere(spark, sf_dir), "msg_id")
    return S.explode_spans(merged).select("msg_id", "start", "end", "kind", "raw")


def merge_rows(spark, sf_dir):
    """The same tables merged without lists, in small buckets."""
    return merge_span_rows(*_elsewhere(spark, sf_dir), "msg_id", 64).select("msg_id", "start", "end", "kind", "raw")


# ---- streams ---------------------------------------------------------------------------------------
def _stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows as a stream over files."""
    _states(spark)
    folder = new_folder(spark)
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def _states(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _batches(spark: SparkSession, folder: str, df: DataFrame, batch: str, numbers) -> None:
    """Append the rows of each batch number to a folder, one file for each, in the order of the numbers.

    All tasks read and filter the rows; only the file of a batch is written by one.
    """
    for number in numbers:
        df.where(F.expr(batch) == number).repartition(1).write.mode("append").parquet(folder)


def _by_file(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream over the files of a folder, each a micro-batch."""
    _states(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(stream: DataFrame, folder: str) -> None:
    (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())


def _written(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives for all files that are there."""
    folder = new_folder(spark)
    _run(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _restarted(spark: SparkSession, df: DataFrame, batch: str, count: int, job) -> DataFrame:
    """What `job` makes of `count` micro-batches, stopped half way and started again from its checkpoint."""
    files, folder = new_folder(spark), new_folder(spark)
    df = materialize(df)
    for numbers in (range(count // 2), range(count // 2, count)):
        _batches(spark, files, df, batch, numbers)
        stream = job(_by_file(spark, files, df.schema))
        _run(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_detect(spark, sf_dir):
    stream = jobs.stream_detect(_stream(spark, K.turns(spark, sf_dir).select("msg_id", "text")))
    folder = new_folder(spark)
    jobs.write_split(stream, f"{folder}/allowed", f"{folder}/blocked", f"{folder}/checkpoint").awaitTermination()
    both = [spark.read.schema(stream.schema).parquet(f"{folder}/{part}/batch=*") for part in ("allowed", "blocked")]
    return both[0].unionByName(both[1]).select("msg_id", "blocked", "blocked_kind")


SETTING_CHANGES = [(1, "custom_watchlist", '["Project Helios"]'), (2, "disabled_packs", '["core","payment"]'),
                   (3, "custom_watchlist", '["Halcyon Labs","Project Helios","example.com/p"]'), (4, "disabled_packs", '["identity"]')]


def stream_settings(spark, sf_dir):
    """Turns in micro-batches of two each; the settings change after the first."""
    turns = materialize(K.turns(spark, sf_dir).select("msg_id", "turn", "text"))
    files, settings, folder = (new_folder(spark) for _ in range(3))
    for changes, numbers in ((SETTING_CHANGES[:2], [0]), (SETTING_CHANGES[2:], [1, 2])):
        spark.createDataFrame(changes, "seq long, key string, value string").write.mode("append").parquet(settings)
        _batches(spark, files, turns, "least(turn div 2, 2)", numbers)
        jobs.write_detected(_by_file(spark, files, turns.schema), lambda session: session.read.parquet(settings),
                            f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    rows = S.explode_spans(spark.read.parquet(f"{folder}/out/batch=*"))
    return rows.select("msg_id", "start", "end", "kind", "raw", "blocked", "blocked_kind")


def stream_alias(spark, sf_dir):
    """Spans by turn in four micro-batches, with a restart after the second."""
    long = S.explode_spans(detected(spark, sf_dir)).select("conv_id", "turn", "start", "kind", "raw")
    return _restarted(spark, long, "least(turn, 3)", 4, jobs.stream_alias)


def stream_rehydrate(spark, sf_dir):
    """Chunks dealt over five micro-batches whatever their order, the map of some after their chunks; one restart."""
    chunks, messages = chunked(spark, sf_dir)
    reverse = messages.select("msg_id", F.lit(jobs.MAP_SEQ).alias("seq"), F.lit("Map").alias("event"), F.lit("").alias("delta"),
                              F.expr(L.reverse_sql("spans")).alias("reverse"))
    rows = reverse.unionByName(chunks, allowMissingColumns=True)
    return _restarted(spark, rows, "pmod(xxhash64(msg_id, seq), 5)", 5, jobs.stream_rehydrate)


def stream_audit_chain(spark, sf_dir):
    """The log by day in micro-batches, with a restart."""
    rows = log(spark, sf_dir).select("conv_id", "seq", "ts", "kind", "raw_hash", "alias", "action")
    signed = _restarted(spark, rows, "(cast(substr(ts, 9, 2) as int) - 1) div 4", 4, lambda s: jobs.stream_audit_chain(s, "conv_id", shards=4))
    return signed.select("chain_id", "ts", "seq", "prev_hash", "sig")


LATE = "CASE turn % 4 WHEN 0 THEN 5 WHEN 1 THEN 600 WHEN 2 THEN 601 ELSE -1 END"


def stream_late_scan(spark, sf_dir):
    """Model answers 5 seconds, 10 minutes, a second more, or one second before the sending; some arrive twice."""
    sent = block_decision(turn_spans(spark, sf_dir)).withColumn("sent_at", F.expr(f"cast({TS} as timestamp)"))
    at = F.timestamp_add("second", F.expr(f"cast({LATE} as int)"), F.col("sent_at"))
    late = answers(spark, sf_dir).select("msg_id", F.col("spans").alias("late")).join(
        sent.select("msg_id", "turn", "sent_at"), "msg_id").select("msg_id", at.alias("found_at"), F.col("late").alias("spans"), "turn")
    late = late.unionByName(late.where("turn % 3 = 0")).drop("turn")
    # A last row of each, years later, moves the watermarks so that every list is decided.
    end = spark.range(1).select(F.lit("END").alias("msg_id"), F.lit("2030-01-01").cast("timestamp").alias("found_at"),
                                F.expr(f"cast(array() as {SPANS_TYPE})").alias("spans"))
    sent = sent.where("NOT blocked").select("msg_id", "sent_at", "spans").unionByName(end.withColumnRenamed("found_at", "sent_at"))
    found = jobs.stream_late_scan(_stream(spark, late.unionByName(end)), _stream(spark, sent), "10 minutes", "30 days")
    rows = _written(spark, found).where("msg_id <> 'END'")
    return rows.select("msg_id", "status", "start", "kind", "raw_hash", "alias", "action", "source")


def _audit_stream(spark, sf_dir) -> DataFrame:
    rows = log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "kind", "action")
    # A last row, years later, moves the watermark so that every window before it is given out.
    end = spark.range(1).select(F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit("END").alias("kind"), F.lit("END").alias("action"))
    return _stream(spark, rows.unionByName(end))


def stream_audit_metrics(spark, sf_dir):
    stream = _audit_stream(spark, sf_dir)
    day = _written(spark, jobs.stream_audit_metrics(stream, "24 hours", "6 hours"))
    week = _written(spark, jobs.stream_audit_metrics(stream, "7 days", "1 day"))
    return (day.withColumn("span", F.lit("24h")).unionByName(week.withColumn("span", F.lit("7d")))
            .filter(F.col("window_end") < "2029-01-01"))


def stream_audit_totals(spark, sf_dir):
    folder, kept = new_folder(spark), []
    stream = jobs.stream_audit_totals(_audit_stream(spark, sf_dir))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        kept.append(number)
    (stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{folder}/{max(kept)}").filter("action <> 'END'")


QUERIES = {
    "read_messages": read_messages, "list_conversations": list_conversations, "read_eval_corpus": read_eval_corpus,
    "load_spans_json": load_spans_json, "write_messages": write_messages, "latest_settings": latest_settings,
    "read_watchlist": read_watchlist, "read_disabled_packs": read_disabled_packs, "merge_span_tables": merge_tables, "merge_span_rows": merge_rows,
    "stream_detect": stream_detect, "stream_alias": stream_alias, "stream_rehydrate": stream_rehydrate,
    "stream_settings": stream_settings, "stream_audit_chain": stream_audit_chain, "stream_late_scan": stream_late_scan,
    "stream_audit_metrics": stream_audit_metrics, "stream_audit_totals": stream_audit_totals,
}

# ---- expected results in DuckDB ------------------------------------------------------------------
_MESSAGES = f"{TURN_CTES}, created AS (SELECT *, {CREATED} AS created_at FROM turns)"


def _window(span: str, size: str, slide: int) -> str:
    """Sliding windows: each row belongs to the windows that start up to their length before it."""
    return f"""
SELECT began AS window_start, began + INTERVAL {size} AS window_end, count(*) FILTER (WHERE action = 'ALIAS') AS redactions,
  count(*) FILTER (WHERE action = 'BLOCK') AS blocks, count(DISTINCT kind)::INT AS classes, '{span}' AS span
FROM (SELECT a.*, make_timestamp(((epoch(ts::TIMESTAMP)::BIGINT // {slide}) - k) * {slide} * 1000000) AS began FROM audit a, range(0, {{n}}) r(k))
GROUP BY began"""


ORACLES = {
    "write_messages": f"WITH RECURSIVE {ALIASED} SELECT t.msg_id, t.conv_id, t.role, t.text AS text_raw, r.text_aliased, {CREATED} AS created_at "
                      f"FROM turns t JOIN rewritten r USING (msg_id)",
    "read_messages": f"""
WITH RECURSIVE {_MESSAGES} SELECT msg_id, created_at, false AS asked FROM created
UNION ALL SELECT msg_id, created_at, true FROM created WHERE conv_id = 'c3'""",
    "list_conversations": f"""
WITH RECURSIVE {_MESSAGES}, c AS (SELECT conv_id AS id, max(created_at) AS created_at FROM created GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200)
SELECT id, created_at, id IN (SELECT t.conv_id FROM turns t JOIN spans s USING (msg_id)) AS shielded FROM c""",
    "load_spans_json": f"""
WITH RECURSIVE {TSPANS} SELECT msg_id, "start", "end", kind, raw, CASE WHEN length(msg_id) % 2 = 0 THEN 1.0 ELSE c END::FLOAT AS confidence
FROM (SELECT *, {O.confidence()} AS c FROM tspans) WHERE length(msg_id) % 2 = 0 OR NOT contains(msg_id, '7')""",
    "read_eval_corpus": f"""
SELECT concat('p', prompt_id) AS id, text, expected, prompt_id % 2 = 0 AS semantic_only, NULL::VARCHAR AS note
FROM ({PROMPTS}) JOIN (SELECT prompt_id, string_agg(concat(kind, '=', raw), ' ' ORDER BY kind, raw) AS expected FROM ({EXPECTED}) GROUP BY 1) USING (prompt_id)""",
    "latest_settings": f"""
SELECT key, value FROM (SELECT concat(owner, '/', key) AS key, value, seq FROM ({SETTINGS})) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1""",
    "read_watchlist": f"""
SELECT seq, owner, unnest(from_json(value, '["VARCHAR"]')) AS item FROM ({SETTINGS}) WHERE key = 'custom_watchlist' AND json_valid(value)""",
    "read_disabled_packs": f"""
SELECT * FROM (SELECT seq, owner, unnest(from_json(value, '["VARCHAR"]')) AS item FROM ({SETTINGS}) WHERE key = 'disabled_packs' AND json_valid(value))
WHERE item IN ({sql_list(TOGGLEABLE_PACKS)})""",
    "merge_span_tables": f"""
WITH RECURSIVE {TURN_CTES}, second AS (SELECT msg_id, k, (turn * 7 + k * 11)::INT AS s, (turn * 7 + k * 11 + 8)::INT AS e FROM turns, range(0, 6) r(k))
SELECT msg_id, "start", "end", kind, raw FROM spans UNION ALL SELECT msg_id, s, e, 'ORG_NER', concat('w', k) FROM second x
WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.msg_id = x.msg_id AND p."start" < x.e AND x.s < p."end")""",
    "stream_detect": f"""
WITH RECURSIVE {TURN_CTES}, {BLOCKED} SELECT t.msg_id, blocked_kind IS NOT NULL AS blocked, blocked_kind FROM turns t LEFT JOIN blocked USING (msg_id)""",
    "stream_alias": f'WITH RECURSIVE {ALIASED} SELECT conv_id, turn, "start", kind, raw, alias FROM aspans',
    "stream_rehydrate": f"WITH RECURSIVE {CHUNK_CTES} SELECT msg_id, seq, CASE WHEN done THEN 'Done' ELSE 'Token' END AS event, emitted FROM emitted",
    "stream_audit_metrics": f"WITH RECURSIVE {AUDIT} " + _window("24h", "24 HOUR", 21_600).format(n=4) + " UNION ALL " + _window("7d", "7 DAY", 86_400).format(n=7),
    "stream_audit_totals": f"WITH RECURSIVE {AUDIT} SELECT action, kind, count(*) AS rows FROM audit GROUP BY ALL",
}
_EARLY = """SELECT w.* FROM watch w JOIN texts t USING (doc_id) WHERE CASE WHEN t.turn < 2 THEN lower(w.raw) = 'project helios'
  ELSE lower(w.raw) IN ('project helios', 'halcyon labs', 'example.com/p') END"""
ORACLES["stream_settings"] = f"""
WITH RECURSIVE texts AS MATERIALIZED (SELECT msg_id AS doc_id, turn, text FROM ({K.turns_sql(K.DUCKDB)})),
{merged_ctes('texts', terms=_EARLY, l1="SELECT s.* FROM spans s JOIN texts t USING (doc_id) WHERE " + O.pack('s.kind') + " <> CASE WHEN t.turn < 2 THEN 'payment' ELSE 'identity' END",
             packs="CASE WHEN (SELECT turn FROM texts t WHERE t.doc_id = s.doc_id) < 2 THEN 'payment' ELSE 'identity' END")},
b AS (SELECT doc_id, arg_min(kind, "start") AS blocked_kind FROM merged WHERE {O.critical()} GROUP BY doc_id)
SELECT m.doc_id AS msg_id, m."start", m."end", m.kind, m.raw, b.doc_id IS NOT NULL AS blocked, b.blocked_kind FROM merged m LEFT JOIN b USING (doc_id)"""
ORACLES["stream_audit_chain"] = AUDIT_ORACLES["audit_chain"]
ORACLES["stream_late_scan"] = f"""
WITH RECURSIVE {TURN_CTES}, {_ANSWER_SPANS}, {BLOCKED},
timed AS (SELECT t.msg_id, CASE WHEN b.msg_id IS NULL AND {LATE} BETWEEN 0 AND 600 THEN 'audited' ELSE 'unmatched' END AS status
  FROM turns t LEFT JOIN blocked b USING (msg_id))
SELECT t.msg_id, t.status, l."start"::INT AS "start", l.kind, sha256(l.raw) AS raw_hash, '' AS alias, 'PARANOID' AS action, 'llm' AS source
FROM timed t JOIN late l USING (msg_id) WHERE t.status = 'audited' AND NOT EXISTS (
  SELECT 1 FROM spans p WHERE p.msg_id = t.msg_id AND p."start" < l."end" AND l."start" < p."end")
UNION ALL SELECT msg_id, status, NULL, NULL, NULL, NULL, NULL, NULL FROM timed WHERE status = 'unmatched'"""
ORACLES["merge_span_rows"] = ORACLES["merge_span_tables"]
