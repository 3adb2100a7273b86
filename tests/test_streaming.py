"""Streams over several micro-batches: state that is read back, early chunks, expiry, changing settings."""

from __future__ import annotations

import glob
import random

import pandas as pd
from pyspark.sql import functions as F

from hushspan.operators import alias as L
from hushspan.operators import scan as S
from hushspan.plans import storage as P
from hushspan.streaming import jobs
from hushspan.streaming.ordering import in_order

CHUNKS = "msg_id string, seq int, event string, delta string, reverse array<struct<alias string, raw string>>, at timestamp, batch int"


class Held(dict):
    """A map state in memory."""

    def updateValue(self, key, value):
        self[key] = value

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]


def test_frames_are_sorted_as_one_whatever_their_number():
    random.seed(1)
    rows = [(random.randrange(50), random.randrange(9), i) for i in range(2000)]
    for size, frames, part in ((3000, 4, 512), (100, 4, 7), (1, 2, 1), (333, 1, 100)):
        held = Held()
        given = (pd.DataFrame(rows[at:at + size], columns=["a", "b", "i"]) for at in range(0, len(rows), size))
        out = list(in_order(given, ["a", "b"], held, frames, part, out_rows=97))
        got = [tuple(r) for f in out for r in f.itertuples(index=False)]
        assert [g[:2] for g in got] == sorted(r[:2] for r in rows) and sorted(got) == sorted(rows) and not held
    assert list(in_order(iter([]), ["a"], Held())) == []


def batches(folder):
    return len(glob.glob(f"{folder}/checkpoint/commits/[0-9]*"))


def run(spark, tmp_path, df, job, count, name="s", stops=1):
    """Micro-batches of column `batch`, stopped `stops` times and started again."""
    files, folder = str(tmp_path / f"{name}-in"), str(tmp_path / name)
    cuts = [count * i // (stops + 1) for i in range(stops + 2)]
    for low, high in zip(cuts, cuts[1:]):
        P._batches(spark, files, df, "batch", range(low, high))
        stream = job(P._by_file(spark, files, df.schema))
        P._run(stream, folder)
    assert batches(folder) >= count
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def response(msg, deltas, last="Done"):
    return [(msg, -1, "Map", "", [("⟦email_01⟧", f"{msg}@x.co"), ("⟦ssn_01⟧", "123-45-6789")])] + [
        (msg, i, "Token", d, None) for i, d in enumerate(deltas)] + [(msg, len(deltas), last, "", None)]


def test_chunks_in_any_order_and_again(spark, tmp_path):
    random.seed(3)
    texts = {f"m{k}": "".join(random.choice(["⟦email_01⟧", "⟦ssn_01⟧", " and ", "x", "⟦open ", "é😀", "⟧"]) for _ in range(40)) for k in range(12)}
    rows = []
    for msg, text in texts.items():
        sent = response(msg, [text[i:i + 5] for i in range(0, len(text), 5)])
        rows += [(*r, None, random.randrange(6)) for r in sent]
        # Some arrive twice, before their response ends.
        rows += [(*r[:5], None, 0) for r in random.sample(sent[1:-1], 3)]
    df = spark.createDataFrame(rows, CHUNKS)
    got = run(spark, tmp_path, df, jobs.stream_rehydrate, 6, stops=2)
    unique = df.dropDuplicates(["msg_id", "seq"])
    messages = unique.where("seq = -1").select("msg_id", F.expr(
        "transform(reverse, r -> named_struct('start', 0, 'end', 0, 'kind', '', 'raw', r.raw, 'alias', r.alias, 'confidence', 1f))").alias("spans"))
    wanted = L.rehydrate_chunks(unique.where("seq >= 0").select("msg_id", "seq", "event", "delta"), messages)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_a_response_that_stops_is_given_out_as_it_is(spark, tmp_path):
    def at(minute):
        from datetime import datetime, timedelta
        return datetime(2024, 1, 1) + timedelta(minutes=minute)

    whole = [(*r, at(0), 0) for r in response("whole", ["a ⟦email", "_01⟧"])]
    stuck = [(*r, at(0), 0) for r in response("stuck", ["mail ⟦email", "_01⟧ lost", " ⟦ssn_01⟧", " end"]) if r[1] != 1 and r[2] != "Done"]
    mapless = [(*r, at(0), 1) for r in response("mapless", ["b ⟦email_01⟧"]) if r[1] >= 0]
    later = [("later", -1, "Map", "", [], at(minute), batch) for minute, batch in ((30, 2), (60, 3))]
    df = spark.createDataFrame(whole + stuck + mapless + later, CHUNKS)
    got = run(spark, tmp_path, df, lambda s: jobs.stream_rehydrate(s.withWatermark("at", "1 minute"), 5 * 60_000), 4)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted([
        ("whole", 0, "Token", "a "), ("whole", 1, "Token", "whole@x.co"), ("whole", 2, "Done", ""), ("stuck", 0, "Token", "mail "),
        ("stuck", 1, "Expired", "⟦email"), ("stuck", 2, "Expired", " ⟦ssn_01⟧"), ("stuck", 3, "Expired", " end"),
        ("mapless", 0, "Expired", "b ⟦email_01⟧"), ("mapless", 1, "Expired", "")])


def test_a_hot_conversation_keeps_its_numbers_over_batches(spark, tmp_path):
    random.seed(5)
    rows = [("hot" if n % 3 else f"c{n % 7}", n // 4, n % 4, random.choice(["EMAIL", "SSN"]), random.choice("ab") + str(random.randrange(300)), n // 4 * 4 // 1300)
            for n in range(4000)]
    df = spark.createDataFrame([(*r[:4], random.choice([r[4], r[4].upper()]), min(r[5], 3)) for r in rows],
                               "conv_id string, turn long, start int, kind string, raw string, batch int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = run(spark, tmp_path, df, jobs.stream_alias, 4)
        got = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    vault = L.mint_aliases(df.select("conv_id", "turn", "start", "kind", "raw"))
    wanted = df.join(vault.select(F.col("scope_id").alias("conv_id"), "kind", F.col("raw_key"), "alias"), ["conv_id", "kind"]).where(
        "lower(raw) = raw_key").select("conv_id", "turn", "start", "kind", "raw", "alias")
    assert got == sorted(map(tuple, wanted.collect())) and len(got) == 4000


def test_a_chain_goes_on_over_batches(spark, tmp_path):
    from hushspan.operators import audit as U

    rows = [("k", n, f"2024-01-01T{n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}Z", "EMAIL", f"h{n}", f"a{n}", "ALIAS", n // 700) for n in range(2000)]
    df = spark.createDataFrame(random.sample(rows, len(rows)), "chain string, seq long, ts string, kind string, raw_hash string, alias string, action string, batch int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = run(spark, tmp_path, df, lambda s: jobs.stream_audit_chain(s, "chain", shards=2), 3)
        got = {r.seq: (r.chain_id, r.prev_hash, r.sig) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r.seq: (r.chain_id, r.prev_hash, r.sig) for r in U.audit_chain(df, "chain", shards=2).collect()}


def test_a_term_counts_from_the_batch_after_it_was_added(spark, tmp_path):
    settings, files = str(tmp_path / "settings"), str(tmp_path / "in")
    schema = "msg_id string, text string, batch int"
    texts = spark.createDataFrame([(f"{b}", "Project Helios, ip 10.0.0.1, Nimbus", b) for b in range(4)], schema)
    steps = [([(1, "custom_watchlist", '["helios"]')], [0, 1]), ([(2, "custom_watchlist", '["nimbus"]'), (3, "disabled_packs", '["network","secrets"]')], [2]),
             ([(4, "custom_watchlist", "broken"), (5, "disabled_packs", "[]")], [3])]
    for changes, numbers in steps:
        spark.createDataFrame(changes, "seq long, key string, value string").write.mode("append").parquet(settings)
        P._batches(spark, files, texts, "batch", numbers)
        jobs.write_detected(P._by_file(spark, files, texts.schema), lambda s: s.read.parquet(settings),
                            str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.msg_id: [s.raw for s in r.spans] for r in spark.read.parquet(str(tmp_path / "out/batch=*")).collect()}
    assert got == {"0": ["Helios", "10.0.0.1"], "1": ["Helios", "10.0.0.1"], "2": ["Nimbus"], "3": ["10.0.0.1"]}


def test_late_lists_are_audited_once_and_in_time(spark, tmp_path):
    from datetime import datetime, timedelta

    began = datetime(2024, 1, 1)
    span = "array<struct<start:int,end:int,kind:string,raw:string,alias:string,confidence:float>>"

    def one(*places):
        return [(s, e, "ORG_NER", f"{s}-{e}", "", 0.5) for s, e in places]
    sent = [("a", began, one((0, 4))), ("b", began, []), ("end", began + timedelta(days=9), [])]
    late = [("a", began + timedelta(minutes=3), one((2, 6), (5, 8))), ("a", began + timedelta(minutes=4), one((2, 6), (5, 8))),
            ("b", began + timedelta(minutes=11), one((0, 1))), ("none", began, one((0, 1))), ("b", began, []), ("end", began + timedelta(days=9), [])]
    left = P._stream(spark, spark.createDataFrame(late, f"msg_id string, found_at timestamp, spans {span}"))
    right = P._stream(spark, spark.createDataFrame(sent, f"msg_id string, sent_at timestamp, spans {span}"))
    got = P._written(spark, jobs.stream_late_scan(left, right)).where("msg_id <> 'end'").collect()
    assert sorted((r.msg_id, r.status, r.start) for r in got) == [("a", "audited", 5), ("b", "unmatched", None), ("none", "unmatched", None)]


def test_detection_on_a_stream_equals_the_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"m{i}", "mail a@b.co", i % 2) for i in range(6)], "msg_id string, text string, batch int")
    got = run(spark, tmp_path, df, jobs.stream_detect, 2)
    assert sorted(r.msg_id for r in got.collect()) == sorted(r.msg_id for r in S.detect_patterns(df).collect())


def test_early_chunks_cost_a_call_for_a_block(spark):
    """120 chunks that wait for the first: one stored block, given out in order when the first arrives."""
    calls = []

    class Counted(Held):
        def updateValue(self, key, value):
            calls.append(key)
            super().updateValue(key, value)

        def containsKey(self, key):
            calls.append(key)
            return key in self

        def iterator(self):
            return iter(list(self.items()))

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    state = jobs.CarryState(None)
    state.place, state.reverse, state.early = Value(), Value(), Counted()
    frame = [(n, "Token", f"{n} ", None) for n in range(1, 121)]
    columns = ["seq", "event", "delta", "reverse"]
    early = list(state.handleInputRows(("m",), iter([pd.DataFrame(random.sample(frame, len(frame)), columns=columns)]), None))
    assert not len(early[0]) and len(calls) < 5
    first = [(jobs.MAP_SEQ, "Map", "", [{"alias": "7", "raw": "x"}]), (0, "Token", "0 ", None)]
    out = pd.concat(state.handleInputRows(("m",), iter([pd.DataFrame(first, columns=columns)]), None))
    assert list(out["seq"]) == list(range(121)) and out["emitted"].iloc[17] == "1x " and len(calls) < 10


def test_responses_share_calls(monkeypatch):
    """40 responses in one group, some longer than a block: given out in order, with a call or two for a page and micro-batch."""
    monkeypatch.setattr(jobs, "EARLY_BLOCK", 8)
    monkeypatch.setattr(jobs, "CARRY_PAGES", 3)
    random.seed(8)
    calls = []

    class Pages(Held):
        def containsKey(self, key):
            calls.append(key)
            return key in self

        def updateValue(self, key, value):
            calls.append(key)
            super().updateValue(key, value)

        def keys(self):
            return iter(list(super().keys()))

    rows, wanted, pairs = [], [], {"⟦email_01⟧": "x@y.co"}
    for k in range(40):
        msg, tail = (f"m{k}" if k else None), ""
        deltas = [random.choice(["⟦email_01⟧", "⟦ema", "il_01⟧", "é😀", " "]) for _ in range(random.choice([0, 3, 30]))]
        sent = [(n, "Token", d) for n, d in enumerate(deltas)] + [(len(deltas), "Done", "")]
        rows += [(msg, -1, "Map", "", [{"alias": a, "raw": r} for a, r in pairs.items()])] + [(msg, *r, None) for r in sent]
        rows += [(msg, *r, None) for r in sent[:-1][:2]] + [(msg, len(sent) + 40, "Token", "late", None)]
        for n, event, delta in sent:
            emitted, tail, _ = jobs._carried(event, delta, tail, pairs)
            wanted.append((msg, n, event, emitted))
    ends = {r[0]: n for n, r in enumerate(rows) if r[2] == "Done"}
    order = random.sample(range(len(rows)), len(rows))
    # A row that comes again, or after the end, does so before its response ends.
    order.sort(key=lambda n: n in ends.values())
    state = jobs.CarryGroups()
    state.pages, state.early = Pages(), Pages()
    out = []
    for at in range(0, len(order), 200):
        frame = pd.DataFrame([rows[n] for n in order[at:at + 200]], columns=["msg_id", "seq", "event", "delta", "reverse"])
        before = len(calls)
        out += [tuple(r) for f in state.handleInputRows((1,), iter([frame.iloc[:90], frame.iloc[90:]]), None) for r in f.itertuples(index=False)]
        assert len([c for c in calls[before:] if len(c) == 1]) <= 2 * 3 * 2
    by_place = [(str(r[0]), *r[1:]) for r in out]
    assert sorted(by_place) == sorted((str(r[0]), *r[1:]) for r in wanted)
    assert all([r[1] for r in by_place if r[0] == m] == sorted(r[1] for r in by_place if r[0] == m) for m in {r[0] for r in by_place})
    assert not state.pages and not state.early
