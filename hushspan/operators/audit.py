"""Audit rows, hash chains, metrics and export batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushspan.functions import arrays as A
from hushspan.kinds import CRITICAL_KINDS, MODEL_KINDS, label_sql, sql_list
from hushspan.operators.alias import TURNS_PER_PIECE, token_sql
from hushspan.operators.merge import confidence_tier_sql, source_sql
from hushspan.operators.ranking import running_total
from hushspan.operators.scan import explode_array

# Start of a chain, rows in a feed, rows in an upload batch.
GENESIS, FEED_ROWS, BATCH_ROWS = "genesis", 50, 200

# Chains of one key.  A chain is serial, so a busy key is dealt over a fixed number of them.
CHAIN_SHARDS = 16


def hash_raw(raw: str = "raw") -> Column:
    return F.sha2(F.col(raw), 256)


def audit_rows(messages: DataFrame, msg: str = "msg_id", ts: str = "ts", mode: str = "send") -> DataFrame:
    """Entries for messages with (msg, ts, spans with aliases, blocked).

    `send`: a blocked message logs its first critical span; others log pattern spans, then model
    spans.  `proxy`: a blocked message logs all critical spans.  `late`: second-pass spans.
    """
    s = A.name("s")
    critical = f"filter(spans, {s} -> {s}.kind IN ({sql_list(CRITICAL_KINDS)}))"
    if mode == "late":
        chosen, action, source = "spans", F.lit("PARANOID"), "'llm'"
    elif mode == "proxy":
        chosen, source = f"if(blocked, {critical}, spans)", "'proxy'"
        action = F.when(F.col("blocked"), "BLOCK").otherwise("ALIAS")
    else:
        model = f"{s}.kind IN ({sql_list(MODEL_KINDS)})"
        chosen = (f"if(blocked, slice({critical}, 1, 1), concat(filter(spans, {s} -> NOT {model}), "
                  f"filter(spans, {s} -> {model})))")
        source = source_sql("kind")
        action = F.when(F.col("blocked"), "BLOCK").otherwise("ALIAS")
    rows = messages.select(
        msg, F.col(ts).alias("ts"), action.alias("action"),
        F.expr(f"transform({chosen}, ({s}, i) -> struct(i as seq_in_msg, {s}.kind as kind, "
               f"sha2({s}.raw, 256) as raw_hash, {s}.alias as alias))").alias("__rows"))
    long = explode_array(rows, "__rows").withColumn("source", F.expr(source))
    return long.withColumn("id", F.sha2(F.concat_ws("|", F.col(msg).cast("string"), "seq_in_msg", "action"), 256))


def provisional_block_aliases(blocked_spans: DataFrame, vault: DataFrame) -> DataFrame:
    """Alias shown for the first critical span of blocked messages (scope_id, turn, msg_id, kind, raw).

    It is the vault's token when the value was known before that turn; otherwise the next free number
    at that turn, which is not stored.
    """
    asked = blocked_spans.withColumn("raw_key", F.lower("raw"))
    events = (vault.select("scope_id", "kind", F.col("first_turn").alias("turn"), F.lit(1).alias("one"),
                           F.lit("").alias("msg_id"))
              .unionByName(asked.select("scope_id", "kind", "turn", F.lit(0).alias("one"), "msg_id")))
    counted = running_total(events, ["scope_id", "kind"], ["turn", "one", "msg_id"],
                            F.floor(F.col("turn") / TURNS_PER_PIECE), F.col("one"), "before")
    counted = counted.filter("one = 0").select("scope_id", "kind", "msg_id", "before")
    known = vault.select("scope_id", "kind", "raw_key", "first_turn", F.col("alias").alias("known"))
    joined = (asked.join(counted, ["scope_id", "kind", "msg_id"])
              .join(known, ["scope_id", "kind", "raw_key"], "left"))
    alias = F.when(F.col("first_turn") < F.col("turn"), F.col("known")).otherwise(
        F.expr(token_sql("kind", "(before + 1)")))
    return joined.select("scope_id", "turn", "msg_id", "kind", "raw", alias.alias("alias"))


def signature_sql(prev: str) -> str:
    return f"sha2(concat({prev}, ts, kind, raw_hash, alias, action), 256)"


_SIGNED = ("ts", "kind", "raw_hash", "alias", "action")


def sign(prev: str | None, values: tuple) -> str | None:
    """Signature of an entry behind `prev`, as `signature_sql` gives it; null if a part is missing."""
    if prev is None or None in values:
        return None
    return hashlib.sha256("".join((prev, *values)).encode()).hexdigest()


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chain, prev = object(), None
    for batch in batches:
        names = batch.schema.names
        ids, heads = (batch.column(names.index(n)).to_pylist() for n in ("chain_id", "__head"))
        before, sigs = [], []
        for name, head, *values in zip(ids, heads, *(batch.column(names.index(n)).to_pylist() for n in _SIGNED)):
            if name != chain:
                chain, prev = name, head
            before.append(prev)
            prev = sign(prev, tuple(values))
            sigs.append(prev)
        kept = [i for i, n in enumerate(names) if n != "__head"]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [pa.array(before, pa.string()), pa.array(sigs, pa.string())],
                                         [names[i] for i in kept] + ["prev_hash", "sig"])


def placed_in_chains(rows: DataFrame, chain_key: str, seq: str = "seq", shards: int = CHAIN_SHARDS) -> DataFrame:
    """Add `chain_id`: the rows of a key go to a fixed number of chains by `seq`, never by how many there are."""
    return rows.withColumn("chain_id", F.concat_ws(
        "/", F.col(chain_key).cast("string"), F.pmod(F.col(seq), F.lit(shards)).cast("string")))


def audit_chain(rows: DataFrame, chain_key: str, seq: str = "seq", shards: int = CHAIN_SHARDS,
                heads: DataFrame | None = None) -> DataFrame:
    """Sign audit rows (chain_key, seq, ts, kind, raw_hash, alias, action) into hash chains.

    A chain is serial by nature.  Its key should bound it (a conversation, a day), and rows that come
    later change no signature written before.  They go on from `heads` (chain_id, sig), the last
    signatures stored; a chain without one starts anew.  Chains are sorted, which may spill, and signed
    as they pass, so a long one needs no more memory than a short one.
    """
    placed = placed_in_chains(rows, chain_key, seq, shards)
    if heads is None:
        placed = placed.withColumn("__head", F.lit(GENESIS))
    else:
        # One head for each chain; Spark splits or broadcasts as their number allows.
        placed = placed.join(heads.select("chain_id", F.col("sig").alias("__head")), "chain_id", "left").withColumn(
            "__head", F.coalesce("__head", F.lit(GENESIS)))
    entry = placed.select(F.col(chain_key), "chain_id", "ts", F.col(seq).cast("long").alias("seq"), "kind", "raw_hash", "alias",
                          "action", "__head")
    kind = entry.schema[chain_key].dataType.simpleString()
    ordered = entry.repartition("chain_id").sortWithinPartitions("chain_id", "ts", "seq", "kind", "raw_hash", "alias", "action")
    return ordered.mapInArrow(_sign_batches, (
        f"{chain_key} {kind}, chain_id string, ts string, seq bigint, kind string, raw_hash string, alias string, "
        "action string, prev_hash string, sig string"))


def chain_heads(chain: DataFrame) -> DataFrame:
    """Last signature of each chain, to go on from."""
    return chain.groupBy("chain_id").agg(F.max_by("sig", F.struct("ts", "seq")).alias("sig"))


def audit_verify(chain: DataFrame) -> DataFrame:
    """Add `sig_ok` and `link_ok`.  Every row is checked on its own; only `lag` needs its chain."""
    order = W.partitionBy("chain_id").orderBy("ts", "seq")
    return (chain
            .withColumn("sig_ok", F.col("sig") == F.expr(signature_sql("prev_hash")))
            .withColumn("link_ok", F.col("prev_hash") == F.coalesce(F.lag("sig").over(order), F.lit(GENESIS))))


def audit_feed(audit: DataFrame, limit: int = FEED_ROWS) -> DataFrame:
    """Newest rows; runs as a top-k, not a full sort."""
    return audit.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(limit)


def audit_metrics(audit: DataFrame, now: Column) -> DataFrame:
    """Lifetime and windowed counts in one pass; `ts` is a timestamp here."""
    def count(*tests: Column) -> Column:
        test = tests[0]
        for t in tests[1:]:
            test = test & t
        return F.count_if(test)
    day, week = now - F.expr("interval 1 day"), now - F.expr("interval 7 days")
    alias, block = F.col("action") == "ALIAS", F.col("action") == "BLOCK"
    at = F.col("ts")
    return audit.agg(
        count(alias).alias("redactions_total"), count(block).alias("blocks_total"),
        F.countDistinct("kind").alias("classes"), count(alias, at >= day).alias("redactions_24h"),
        count(alias, at >= week).alias("redactions_7d"), count(block, at >= week).alias("blocks_7d"))


def pending(audit: DataFrame, ledger: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows not uploaded yet: by the column, and by the ledger of uploads when there is one."""
    rows = audit.filter(F.col("uploaded_at").isNull())
    return rows if ledger is None else rows.join(ledger.select(key), key, "left_anti")


def pending_uploads(audit: DataFrame, ledger: DataFrame | None = None, limit: int = BATCH_ROWS,
                    key: str = "id") -> DataFrame:
    """The oldest pending rows, as the next batch."""
    return pending(audit, ledger, key).orderBy("ts", "seq").limit(limit)


def mark_uploaded(ledger: DataFrame | None, batch: DataFrame, now_sec: int, key: str = "id") -> DataFrame:
    """Ledger after a batch was taken (or had been taken before): append-only, no update in place."""
    new = batch.select(key, F.lit(now_sec).cast("long").alias("uploaded_at"))
    return new if ledger is None else ledger.unionByName(new)


def unix_seconds_sql(ts: str) -> str:
    """Seconds of an RFC 3339 text; 0 when it is none."""
    return f"coalesce(unix_seconds(try_cast({ts} as timestamp)), 0L)"


def export_batches(rows: DataFrame, size: int = BATCH_ROWS, ts: str = "ts") -> DataFrame:
    """All pending rows in upload batches: (batch, n, events JSON).  Signatures stay behind.

    The oldest come first, those of one second by `seq`; a bad `ts` counts as second 0.  Numbering is
    global, so it is done in pieces of a second and of 1,000 numbers of `seq`, which are shifted by the
    pieces before; a busy second or very many bad times are spread over pieces.  Pieces are summed
    within their second, seconds within their day and days at last, so the largest task meets a piece,
    a second's pieces, a day's seconds or a row for each day, however many rows there are.
    """
    rows = rows.withColumn("__unix", F.expr(unix_seconds_sql(ts))).withColumn("__all", F.lit(1))
    piece = F.col("__unix") * (1 << 24) + F.least(F.floor(F.col("seq") / 1000), F.lit((1 << 24) - 1))
    numbered = running_total(rows, ["__all"], ["__unix", "seq"], piece, out="__rn", levels=(1 << 24, 86_400))
    event = F.struct("__rn", F.struct(F.col("__unix").alias("ts"), "kind", "source", "action", "raw_hash", "alias")
                     .alias("e"))
    grouped = (numbered.withColumn("batch", F.floor((F.col("__rn") - 1) / size))
               .groupBy("batch").agg(F.sort_array(F.collect_list(event)).alias("__e"), F.count("*").alias("n")))
    return grouped.select("batch", "n", F.expr("to_json(transform(__e, x -> x.e))").alias("events"))


def spans_by_kind(long_spans: DataFrame, by: str) -> DataFrame:
    """Spans per kind for each message or conversation, with total and number of kinds."""
    counts = (long_spans.groupBy(by, "kind")
              .agg(F.count("*").alias("spans"), F.max("confidence").alias("confidence")))
    # At most one row per kind, 55 in all, meets in a window group.
    group = W.partitionBy(by)
    return (counts.withColumn("label", F.expr(label_sql("kind")))
            .withColumn("total", F.sum("spans").over(group)).withColumn("classes", F.count("*").over(group))
            .withColumn("band", F.expr(confidence_tier_sql("confidence"))))


def aliased_share(metrics: DataFrame) -> DataFrame:
    """Share of aliased among aliased and blocked of the week, in percent; 100 when there are none."""
    total = F.col("redactions_7d") + F.col("blocks_7d")
    share = F.when(total == 0, F.lit(100)).otherwise(
        F.floor(F.col("redactions_7d") * 100.0 / total + 0.5).cast("int"))
    return metrics.withColumn("aliased_share", share)
