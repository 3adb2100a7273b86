"""Registered queries for detection quality, on prompts whose expected spans are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushspan.operators import evaluate as E
from hushspan.operators import scan as S
from hushspan.plans import corpus as K
from hushspan.plans import oracle as O
from hushspan.sources.interim import materialize

_SSN = "concat(lpad(concat('', o_orderkey * 7919 % 1000), 3, '0'), '-', lpad(concat('', o_orderkey * 31 % 100), 2, '0'), '-', lpad(concat('', o_orderkey * 17 % 10000), 4, '0'))"
_CARD = "CASE o_orderkey % 3 WHEN 0 THEN '4111 1111 1111 1111' ELSE '4111 1111 1111 1112' END"
_MAIL = "concat('user', o_orderkey % 50, '@example1.com')"
_EMP = "concat('EMP-', lpad(concat('', o_custkey % 100000), 5, '0'))"
# Prompts of planted values.  One address stands twice, some numbers are not valid, a name needs a model.
PROMPTS = f"""
SELECT o_orderkey AS prompt_id, concat('Mail ', {_MAIL}, ', ssn is ', {_SSN}, ' and card ', {_CARD}, '; badge ', {_EMP},
  '. Acme met ', {_MAIL}, ' at 10.0.0.', o_orderkey % 300) AS text FROM orders"""
EXPECTED = f"""
SELECT o_orderkey AS prompt_id, 'EMAIL' AS kind, {_MAIL} AS raw FROM orders
UNION ALL SELECT o_orderkey, 'EMAIL', {_MAIL} FROM orders WHERE o_orderkey % 4 <> 0
UNION ALL SELECT o_orderkey, 'SSN', {_SSN} FROM orders
UNION ALL SELECT o_orderkey, 'CREDITCARD', {_CARD} FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'EMPID', {_EMP} FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, 'ORG_NER', 'Acme' FROM orders WHERE o_orderkey % 5 = 0"""
# What a model would add: another kind of the same class, and some that nobody expects.
MODEL = """
SELECT o_orderkey AS prompt_id, 'CODENAME_NER' AS kind, 'Acme' AS raw FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT o_orderkey, 'PERSON_NER', 'Mail' FROM orders WHERE o_orderkey % 8 = 0"""
LATENCIES = """
SELECT event_type AS config, cast(floor(value * 10) AS BIGINT) AS ms FROM events WHERE value IS NOT NULL"""
ENTITIES = """
SELECT o_orderkey AS prompt_id, CASE o_orderkey % 10 WHEN 0 THEN 'EMAIL_ADDRESS' WHEN 1 THEN 'PHONE_NUMBER' WHEN 2 THEN 'US_SSN'
  WHEN 3 THEN 'IP_ADDRESS' WHEN 4 THEN 'URL' WHEN 5 THEN 'PERSON' WHEN 6 THEN 'LOCATION' WHEN 7 THEN 'ORGANIZATION'
  WHEN 8 THEN 'DATE_TIME' ELSE 'NRP' END AS entity_type FROM orders"""
CONFIGS = ["patterns", "patterns and model"]


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    K.load_dealt(spark, sf_dir, "orders")
    df = S.detect_patterns(spark.sql(PROMPTS))
    K.load(spark, sf_dir, "orders", "events")
    return S.explode_spans(df).select("prompt_id", "kind", "raw")


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    actual = materialize(_found(spark, sf_dir).unionByName(spark.sql(MODEL)))
    return actual, spark.sql(EXPECTED)


def score_spans(spark, sf_dir):
    return E.score_spans(*_sides(spark, sf_dir))


def kind_equivalence(spark, sf_dir):
    actual, expected = _sides(spark, sf_dir)
    both = actual.select(F.lit("actual").alias("side"), "kind").unionByName(expected.select(F.lit("expected").alias("side"), "kind"))
    return both.groupBy("side", E.kind_class().alias("class")).agg(F.count("*").alias("n"))


def critical_misses(spark, sf_dir):
    return E.critical_misses(*_sides(spark, sf_dir))


def _totals(spark, sf_dir) -> DataFrame:
    return E.score_spans(*_sides(spark, sf_dir)).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def precision_recall_f1(spark, sf_dir):
    return E.precision_recall_f1(_totals(spark, sf_dir))


def latency_summary(spark, sf_dir):
    K.load(spark, sf_dir, "events")
    return E.latency_summary(spark.sql(LATENCIES), by=("config",))


def quality_gates(spark, sf_dir):
    """Gates of both modes for the prompts, with the latencies of one kind of event."""
    actual, expected = _sides(spark, sf_dir)
    scores = E.precision_recall_f1(E.score_spans(actual, expected).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    missed = E.critical_misses(actual, expected).agg(F.count("*").alias("critical_missed"))
    p99 = E.latency_summary(spark.sql(LATENCIES).filter("config = 'click'")).select("p99_ms")
    one = F.lit(1).alias("one")
    row = (scores.select("precision", one).join(missed.select("critical_missed", one), "one")
           .join(p99.select("p99_ms", one), "one").drop("one"))
    return E.quality_gates(row, "fast").unionByName(E.quality_gates(row, "full"))


def _configs(spark, sf_dir) -> DataFrame:
    found = materialize(_found(spark, sf_dir))
    model = spark.sql(MODEL)
    first, second = (F.lit(c).alias("config") for c in CONFIGS)
    return found.select("*", first).unionByName(found.select("*", second)).unionByName(model.select("*", second))


def _per_kind(spark, sf_dir):
    return E.compare_configs(_configs(spark, sf_dir), spark.sql(EXPECTED), CONFIGS)


def compare_table(spark, sf_dir):
    return E.compare_table(_configs(spark, sf_dir), spark.sql(EXPECTED), CONFIGS)


def compare_configs(spark, sf_dir):
    return _per_kind(spark, sf_dir)


def compare_totals(spark, sf_dir):
    per_kind = _per_kind(spark, sf_dir)
    ms = spark.sql(LATENCIES).withColumn("config", F.when(F.col("config") == "click", CONFIGS[0]).when(F.col("config") == "view", CONFIGS[1]))
    return E.compare_totals(per_kind, ms.filter("config IS NOT NULL"))


def map_external_kinds(spark, sf_dir):
    K.load(spark, sf_dir, "orders")
    return E.map_external_kinds(spark.sql(ENTITIES))


def error_listing(spark, sf_dir):
    return E.error_listing(*_sides(spark, sf_dir))


QUERIES = {
    "score_spans": score_spans, "kind_equivalence": kind_equivalence, "critical_misses": critical_misses,
    "precision_recall_f1": precision_recall_f1, "latency_summary": latency_summary, "quality_gates": quality_gates,
    "compare_configs": compare_configs, "compare_totals": compare_totals, "compare_table": compare_table, "map_external_kinds": map_external_kinds,
    "error_listing": error_listing,
}

# ---- expected results in DuckDB ------------------------------------------------------------------
_CLASS = "CASE WHEN kind IN ('ORG_NER', 'CODENAME_NER') THEN 'ORG_OR_CODENAME' ELSE kind END"
_FOUND = f"""prompts AS MATERIALIZED ({PROMPTS}), {O.hits_ctes('prompts', 'prompt_id')}, {O.spans_ctes('prompt_id')},
expected AS MATERIALIZED ({EXPECTED}), model AS MATERIALIZED ({MODEL})"""
_ACTUAL = f"{_FOUND}, actual AS MATERIALIZED (SELECT prompt_id, kind, raw FROM spans UNION ALL SELECT * FROM model)"


def _ranked(source: str, keys: str) -> str:
    """Copies numbered, so that equal rows can be paired off one by one."""
    return f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY kind) AS copy FROM (SELECT *, {_CLASS} AS class FROM {source})"


_PAIRED = f"""{_ACTUAL}, a AS MATERIALIZED ({_ranked('actual', 'prompt_id, class, raw')}), e AS MATERIALIZED ({_ranked('expected', 'prompt_id, class, raw')}),
paired AS MATERIALIZED (SELECT coalesce(a.prompt_id, e.prompt_id) AS prompt_id, a.kind AS akind, e.kind AS ekind, coalesce(a.raw, e.raw) AS raw
  FROM a FULL JOIN e ON a.prompt_id = e.prompt_id AND a.class = e.class AND a.raw = e.raw AND a.copy = e.copy)"""
_SUMS = """count(*) FILTER (WHERE akind IS NOT NULL AND ekind IS NOT NULL) AS tp, count(*) FILTER (WHERE ekind IS NULL) AS fp,
  count(*) FILTER (WHERE akind IS NULL) AS fn"""
_PRF = """*, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (
  SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS precision,
            CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS recall"""
_MISSES = f"""SELECT prompt_id, kind, raw FROM expected x WHERE {O.critical()} AND NOT EXISTS (
  SELECT 1 FROM actual y WHERE y.prompt_id = x.prompt_id AND y.kind = x.kind AND y.raw = x.raw)"""


def _latency(source: str) -> str:
    return f"""SELECT config, count(*) AS n, avg(ms) AS avg_ms,
  list_sort(list(ms))[least(floor(count(*) * 0.95), count(*) - 1)::INT + 1] AS p95_ms,
  list_sort(list(ms))[least(floor(count(*) * 0.99), count(*) - 1)::INT + 1] AS p99_ms FROM ({source}) GROUP BY config"""


_KINDS = f"""{_FOUND}, both_ AS (SELECT prompt_id, kind, raw, c AS config FROM spans, (VALUES ('{CONFIGS[0]}'), ('{CONFIGS[1]}')) v(c)
  UNION ALL SELECT *, '{CONFIGS[1]}' FROM model),
wanted AS (SELECT *, c AS config FROM expected, (VALUES ('{CONFIGS[0]}'), ('{CONFIGS[1]}')) v(c)),
a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY config, prompt_id, kind, raw) AS copy FROM both_),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY config, prompt_id, kind, raw) AS copy FROM wanted),
per_kind AS MATERIALIZED (SELECT coalesce(a.config, e.config) AS config, coalesce(a.kind, e.kind) AS kind,
    count(*) FILTER (WHERE a.kind IS NOT NULL AND e.kind IS NOT NULL) AS tp, count(*) FILTER (WHERE e.kind IS NULL) AS fp,
    count(*) FILTER (WHERE a.kind IS NULL) AS fn
  FROM a FULL JOIN e ON a.config = e.config AND a.prompt_id = e.prompt_id AND a.kind = e.kind AND a.raw = e.raw AND a.copy = e.copy GROUP BY ALL)"""

ORACLES = {
    "score_spans": f"WITH RECURSIVE {_PAIRED} SELECT prompt_id, {_SUMS} FROM paired GROUP BY prompt_id",
    "kind_equivalence": f"""
WITH RECURSIVE {_ACTUAL} SELECT 'actual' AS side, {_CLASS} AS class, count(*) AS n FROM actual GROUP BY ALL
UNION ALL SELECT 'expected', {_CLASS}, count(*) FROM expected GROUP BY ALL""",
    "critical_misses": f"WITH RECURSIVE {_ACTUAL} {_MISSES}",
    "precision_recall_f1": f"WITH RECURSIVE {_PAIRED}, t AS (SELECT {_SUMS} FROM paired) SELECT {_PRF} FROM t)",
    "latency_summary": _latency(LATENCIES),
    "quality_gates": f"""
WITH RECURSIVE {_PAIRED}, t AS (SELECT {_SUMS} FROM paired), m AS ({_MISSES}), l AS ({_latency(LATENCIES)}),
r AS (SELECT CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS precision, (SELECT count(*) FROM m) AS critical_missed,
  (SELECT p99_ms FROM l WHERE config = 'click') AS p99_ms FROM t),
g AS (SELECT * FROM r, (VALUES ('fast', 0.80::DOUBLE, 200, true), ('full', 0.75::DOUBLE, 3000, false)) v(mode, least_precision, most_ms, blocks))
SELECT precision, critical_missed, p99_ms, mode, critical_missed = 0 AS misses_ok, precision >= least_precision AS precision_ok, p99_ms <= most_ms AS p99_ok,
  critical_missed = 0 AND precision >= least_precision AND p99_ms <= most_ms AS passed,
  CASE WHEN blocks AND NOT (critical_missed = 0 AND precision >= least_precision AND p99_ms <= most_ms) THEN 1 ELSE 0 END::INT AS exit_code FROM g""",
    "compare_configs": f"WITH RECURSIVE {_KINDS} SELECT {_PRF} FROM per_kind)",
    "compare_totals": f"""
WITH RECURSIVE {_KINDS}, t AS (SELECT config, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM per_kind GROUP BY config),
p AS (SELECT {_PRF} FROM t)), l AS ({_latency(f"SELECT CASE config WHEN 'click' THEN '{CONFIGS[0]}' ELSE '{CONFIGS[1]}' END AS config, ms FROM ({LATENCIES}) WHERE config IN ('click', 'view')")})
SELECT p.*, avg_ms, p95_ms, p99_ms FROM p LEFT JOIN l USING (config)""",
    "compare_table": f"""
WITH RECURSIVE {_KINDS}, sets AS (SELECT config, kind, tp, fp, fn FROM per_kind
  UNION ALL SELECT config, 'all', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM per_kind GROUP BY config),
scored AS (SELECT {_PRF} FROM sets))
SELECT kind, {', '.join(f"max({m}) FILTER (WHERE config = '{c}') AS \"{c}_{m}\"" for c in CONFIGS for m in ('tp', 'fp', 'fn', 'precision', 'recall', 'f1'))}
FROM scored GROUP BY kind""",
    "map_external_kinds": f"""
SELECT * FROM (SELECT *, CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' WHEN 'PHONE_NUMBER' THEN 'PHONE' WHEN 'US_SSN' THEN 'SSN'
  WHEN 'IP_ADDRESS' THEN 'IP' WHEN 'URL' THEN 'URL' WHEN 'PERSON' THEN 'PERSON_NER' WHEN 'LOCATION' THEN 'LOCATION_NER'
  WHEN 'ORGANIZATION' THEN 'ORG_NER' END AS kind FROM ({ENTITIES})) WHERE kind IS NOT NULL""",
    "error_listing": f"""
WITH RECURSIVE {_PAIRED} SELECT prompt_id, 'FP' AS error, akind AS kind, raw FROM paired WHERE ekind IS NULL
UNION ALL SELECT prompt_id, 'FN', ekind, raw FROM paired WHERE akind IS NULL""",
}
