"""Audit chains and metrics, batches, chunks, scores; registered queries against their SQL."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import canonical
from hushspan.operators import alias as L
from hushspan.operators import audit as U
from hushspan.operators import evaluate as E
from hushspan.operators import policy as P
from hushspan.plans.corpus import TABLES

SF = "/root/testdata/sf0.001"
AUDIT = "chain string, seq long, ts string, kind string, raw_hash string, alias string, action string"


def audit(spark, numbers):
    return spark.createDataFrame([("k", n, f"2024-01-01T00:{n // 60:02d}:{n % 60:02d}Z", "EMAIL", f"h{n}", f"a{n}", "ALIAS") for n in numbers], AUDIT)


def test_signatures_stay_when_rows_are_appended(spark):
    first = U.audit_chain(audit(spark, range(200)), "chain")
    whole = {r.seq: r.sig for r in U.audit_chain(audit(spark, range(400)), "chain").collect()}
    assert all(whole[r.seq] == r.sig for r in first.collect())
    later = U.audit_chain(audit(spark, range(200, 400)), "chain", heads=U.chain_heads(first))
    assert {r.seq: r.sig for r in later.collect()} == {n: s for n, s in whole.items() if n >= 200}


def test_changed_and_missing_rows_are_found(spark):
    chain = U.audit_chain(audit(spark, range(64)), "chain", shards=2)
    forged = chain.filter("seq <> 20").withColumn("alias", F.when(F.col("seq") == 10, "forged").otherwise(F.col("alias")))
    checked = {r.seq: (r.sig_ok, r.link_ok) for r in U.audit_verify(forged).collect()}
    assert checked[10] == (False, True) and checked[22] == (True, False)
    assert all(v == (True, True) for n, v in checked.items() if n not in (10, 22))


def test_metrics_windows(spark):
    now = datetime(2024, 6, 1)
    rows = [("ALIAS", now), ("ALIAS", now - timedelta(days=3)), ("ALIAS", now - timedelta(days=30)), ("BLOCK", now - timedelta(days=2))]
    df = spark.createDataFrame([(a, t, "EMAIL") for a, t in rows], "action string, ts timestamp, kind string")
    got = U.aliased_share(U.audit_metrics(df, F.lit(now))).first()
    assert (got.redactions_total, got.redactions_24h, got.redactions_7d, got.blocks_total, got.blocks_7d, got.aliased_share) == (3, 1, 2, 1, 1, 67)


def test_batches_number_every_row_once(spark):
    rows = [(n, "bad" if n % 3 else f"2024-01-01T00:00:{n % 60:02d}Z", "EMAIL", "regex", "ALIAS", f"h{n}", "a") for n in range(5000)]
    df = spark.createDataFrame(rows, "seq long, ts string, kind string, source string, action string, raw_hash string, alias string")
    got = U.export_batches(df, size=200).collect()
    assert sorted(r.batch for r in got) == list(range(25)) and {r.n for r in got} == {200}
    assert sum(r.events.count('"ts":0,') for r in got) == sum(1 for n in range(5000) if n % 3)


def test_chunks_hold_back_half_tokens(spark):
    chunks = spark.createDataFrame([("m", 0, "Token", "hello ⟦em"), ("m", 1, "Token", "ail_01⟧!"), ("m", 2, "Done", "")], "msg_id string, seq int, event string, delta string")
    spans = [(0, 14, "EMAIL", "alice@acme.com", "⟦email_01⟧", 1.0)]
    messages = spark.createDataFrame([("m", spans)], "msg_id string, spans array<struct<start:int,end:int,kind:string,raw:string,alias:string,confidence:float>>")
    got = {r.seq: r.emitted for r in L.rehydrate_chunks(chunks, messages).collect()}
    assert got == {0: "hello ", 1: "alice@acme.com!", 2: ""}


def test_flatten_and_endpoints(spark):
    turns = spark.createDataFrame([(1, 0, "system", '"be terse"'), (1, 1, "user", '[{"type":"text","text":"hello"},{"type":"image"}]'), (1, 2, "assistant", '""')],
                                  "request_id long, turn int, role string, content string")
    assert P.flatten_messages(turns).first().text == "System: be terse\n\nUser: hello"
    urls = [("http://localhost:11434", True), ("http://[::1]:11434/", True), ("http://localhost.evil.com/", False), ("http://localhost@evil.com", False), ("", False)]
    df = spark.createDataFrame(urls, "base_url string, want boolean")
    assert P.classify_endpoint(df).filter("is_local <> want").count() == 0


def test_scores_and_latency(spark):
    schema = "prompt_id int, kind string, raw string"
    actual = spark.createDataFrame([(1, "EMAIL", "a"), (1, "EMAIL", "a"), (1, "CODENAME_NER", "x"), (2, "IP", "i")], schema)
    expected = spark.createDataFrame([(1, "EMAIL", "a"), (1, "ORG_NER", "x"), (2, "SSN", "s")], schema)
    got = {r.prompt_id: (r.tp, r.fp, r.fn) for r in E.score_spans(actual, expected).collect()}
    assert got == {1: (2, 1, 0), 2: (0, 1, 1)}
    assert [tuple(r) for r in E.critical_misses(actual, expected).collect()] == [(2, "SSN", "s")]
    ms = spark.createDataFrame([(float(i),) for i in range(100)], "ms double")
    r = E.latency_summary(ms).first()
    assert (r.n, r.p95_ms, r.p99_ms) == (100, 95, 99)


def test_blocked_turns_use_up_no_numbers(spark):
    got = {r.msg_id: r for r in entry.queries()["egress_payload"](spark, SF).collect()} if os.path.isdir(SF) else {}
    for r in got.values():
        assert (r.payload is None) == (r.egress in ("blocked", "no_provider"))


CHECKED = ["scan_secrets", "resolve_overlaps", "late_scan", "leak_filter", "mint_aliases_incremental", "egress_payload", "audit_rows", "audit_chain",
           "export_batches", "error_listing", "compare_totals", "load_spans_json", "stream_detect", "stream_alias"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_levels_of_sums_number_like_one(spark):
    from hushspan.operators.ranking import running_total

    rows = [(k, (n * 7919) % 5000 - 900, n % 3 + 1) for k in "ab" for n in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    base = spark.createDataFrame([("b", 1000)], "k string, n long")
    for before in (None, base):
        one = running_total(df, ["k"], ["at", "v"], F.floor(F.col("at") / 10), F.col("v"), base=before)
        many = running_total(df, ["k"], ["at", "v"], F.floor(F.col("at") / 10), F.col("v"), base=before, levels=(4, 5))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_a_chain_is_signed_over_batch_ends_and_missing_parts(spark):
    import hashlib

    rows = audit(spark, range(3000)).unionByName(audit(spark, [5000]).withColumn("alias", F.lit(None).cast("string")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = U.audit_chain(rows, "chain", shards=1).orderBy("ts", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    prev = "genesis"
    for r in got[:-1]:
        assert r.prev_hash == prev
        prev = hashlib.sha256("".join([prev, r.ts, r.kind, r.raw_hash, r.alias, r.action]).encode()).hexdigest()
        assert r.sig == prev
    assert got[-1].seq == 5000 and got[-1].prev_hash == prev and got[-1].sig is None


def test_the_comparison_has_each_kind_and_all(spark):
    actual = spark.createDataFrame([(1, "EMAIL", "a", "x"), (1, "EMAIL", "b", "x"), (1, "SSN", "c", "y"), (2, "SSN", "c", "y")],
                                   "prompt_id int, kind string, raw string, config string")
    expected = spark.createDataFrame([(1, "EMAIL", "a"), (1, "SSN", "c")], "prompt_id int, kind string, raw string")
    got = {r.kind: r for r in E.compare_table(actual, expected, ["x", "y"]).collect()}
    assert set(got) == {"EMAIL", "SSN", "all"}
    assert (got["EMAIL"].x_tp, got["EMAIL"].x_fp, got["EMAIL"].x_fn, got["EMAIL"].y_fn) == (1, 1, 0, 1)
    assert (got["all"].x_tp, got["all"].x_fp, got["all"].x_fn, got["all"].y_precision, got["all"].y_recall) == (1, 1, 1, 0.5, 0.5)
