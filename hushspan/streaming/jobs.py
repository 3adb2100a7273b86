"""Structured Streaming forms of detection, aliasing, re-hydration and audit metrics."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hushspan.kinds import KINDS
from hushspan.operators.alias import LEFT, RIGHT
from hushspan.operators.audit import CHAIN_SHARDS, GENESIS, placed_in_chains, sign
from hushspan.operators.merge import detect_all, merge_spans
from hushspan.operators.policy import block_decision
from hushspan.operators.termindex import detect_terms
from hushspan.sources import store
from hushspan.streaming.ordering import in_order


def stream_detect(messages: DataFrame, watchlist=None, disabled_packs=()) -> DataFrame:
    """Stateless detection and blocking on a message stream; append mode."""
    return block_decision(detect_all(messages, watchlist=watchlist, disabled_packs=disabled_packs))


def write_split(stream: DataFrame, allowed_path: str, blocked_path: str, checkpoint: str):
    """Write allowed and blocked messages to two tables.

    The batch number is part of the path, so a batch that is run again overwrites its own output.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.filter("NOT blocked").write.mode("overwrite").parquet(f"{allowed_path}/batch={epoch}")
        batch.filter("blocked").write.mode("overwrite").parquet(f"{blocked_path}/batch={epoch}")
        batch.unpersist()
    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def write_detected(messages: DataFrame, settings: Callable[[SparkSession], DataFrame], path: str, checkpoint: str):
    """Detect and block a message stream under settings that may change while it runs.

    `settings` reads the table of changes (key, value, seq); it is read anew for every micro-batch, so a
    term added or a pack switched off between two batches counts from the second one.  The last value
    of `custom_watchlist` and `disabled_packs` holds; a malformed one switches nothing off and names no
    terms.  Terms reach the texts through the term index, not through the plan.  A batch that is run
    again overwrites its own output, with the settings of then.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        latest = store.latest_settings(settings(batch.sparkSession))
        # At most the packs that exist.
        packs = [r["item"] for r in store.read_disabled_packs(latest).select("item").distinct().collect()]
        # A micro-batch may be a single file, which one task would read and scan.
        batch = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)
        found = detect_all(batch, disabled_packs=packs)
        found = detect_terms(found, store.read_watchlist(latest), term="item", out="__terms")
        merged = merge_spans(found, "spans", "__terms").drop("__terms")
        block_decision(merged).write.mode("overwrite").parquet(f"{path}/batch={epoch}")
    return (messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


class AliasState(StatefulProcessor):
    """Vault of one conversation: (kind, lower-case value) -> number, and a counter per kind."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "kind string, raw_key string", "n int", self.ttl_ms)
        self.counters = handle.getMapState("counters", "kind string", "n int", self.ttl_ms)
        self.held = handle.getMapState("held", "part int", "rows binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # The order of a micro-batch is not given, and numbers follow first appearance.  Frames come one
        # after the other; what stays in memory are the distinct values of the batch.
        known: dict[tuple[str, str], str] = {}
        for frame in in_order(rows, ["turn", "start"], self.held):
            entries = list(zip(frame["kind"], frame["raw"].str.lower()))
            for entry in dict.fromkeys(entries):
                if entry not in known:
                    known[entry] = f"{LEFT}{KINDS[entry[0]][0]}_{self._number(entry):02d}{RIGHT}"
            yield frame.assign(alias=[known[e] for e in entries])[["conv_id", "turn", "start", "kind", "raw", "alias"]]

    def _number(self, entry: tuple[str, str]) -> int:
        """The number of a value: the stored one, or the next of its kind."""
        if self.numbers.containsKey(entry):
            return int(self.numbers.getValue(entry)[0])
        kind = entry[:1]
        n = int(self.counters.getValue(kind)[0]) + 1 if self.counters.containsKey(kind) else 1
        self.counters.updateValue(kind, (n,))
        self.numbers.updateValue(entry, (n,))
        return n

    def close(self) -> None:
        pass


def stream_alias(spans: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Alias a stream of long spans (conv_id, turn, start, kind, raw).

    State is kept per conversation and read back by every later batch, so a value keeps its token;
    with `ttl_ms`, for a long-running stream, a value that was minted so long ago leaves it.  New values
    are numbered by batch, turn and place.  A hot conversation is sorted and handled frame by frame.
    """
    return (spans.select("conv_id", "turn", "start", "kind", "raw").groupBy("conv_id")
            .transformWithStateInPandas(
                statefulProcessor=AliasState(ttl_ms), outputMode="Append",
                timeMode="None" if ttl_ms is None else "ProcessingTime",
                outputStructType="conv_id string, turn bigint, start int, kind string, raw string, alias string"))


#: Place of the row that brings a response's alias map, before its first chunk.
MAP_SEQ = -1
#: Chunks that are kept in state together; a chunk by itself costs several calls to the state's server.
EARLY_BLOCK = 256
#: Groups of responses that never expire, each a key, and pages of responses in a group; both stay while a stream lives.
CARRY_GROUPS = 1024
CARRY_PAGES = 16


class CarryState(StatefulProcessor):
    """One response: the chunk that comes next, the held-back tail, the alias map, and chunks that came too early."""

    def __init__(self, patience_ms: int | None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next int, tail string, waiting int, timer bigint")
        self.reverse = handle.getValueState("reverse", "pairs string")
        self.early = handle.getMapState("early", "block int", "chunks string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        following, tail, waiting, timer = self.place.get() or (MAP_SEQ, "", 0, None)
        pairs = dict(json.loads((self.reverse.get() or ("[]",))[0])) if following > MAP_SEQ else {}
        # Blocks of early chunks that were read; no more than the one that is given out and those that arrive.
        blocks: dict[int, dict[int, tuple]] = {}
        done = False
        for frame in rows:
            arrived = {}
            for seq, event, delta, given in zip(frame["seq"], frame["event"], frame["delta"], frame["reverse"]):
                # A chunk that comes again, after its place was passed, says nothing new.
                if seq >= following:
                    arrived[int(seq)] = (event, delta, given)
            out = []
            while not done:
                if following in arrived:
                    event, delta, given = arrived.pop(following)
                elif waiting and following in self._block(blocks, following):
                    (event, delta), given = blocks[following // EARLY_BLOCK].pop(following), None
                    waiting -= 1
                    if not blocks[following // EARLY_BLOCK]:
                        self.early.removeKey((following // EARLY_BLOCK,))
                else:
                    break
                if following == MAP_SEQ:
                    pairs = {pair["alias"]: pair["raw"] for pair in given} if given is not None else {}
                    if pairs:
                        self.reverse.update((json.dumps(list(pairs.items())),))
                else:
                    emitted, tail, done = _carried(event, delta, tail, pairs)
                    out.append((key[0], following, event, emitted))
                following += 1
            touched = set()
            for seq, (event, delta, _) in arrived.items():
                block = {} if done else self._block(blocks, seq)
                if not done and seq not in block:
                    block[seq] = (event, delta)
                    touched.add(seq // EARLY_BLOCK)
                    waiting += 1
            for number in touched:
                self.early.updateValue((number,), (json.dumps(list(blocks[number].items())),))
            # What was given out of a block stays in the stored form until then; it is passed over when read.
            blocks.clear()
            yield pd.DataFrame(out, columns=["msg_id", "seq", "event", "emitted"])
        if timer is not None:
            self.handle.deleteTimer(timer)
        if done:
            self._forget()
            return
        timer = None
        if self.patience_ms is not None:
            timer = max(timer_values.getCurrentWatermarkInMs(), 0) + self.patience_ms
            self.handle.registerTimer(timer)
        self.place.update((following, tail, waiting, timer))

    def _block(self, blocks: dict, seq: int) -> dict[int, tuple]:
        """The early chunks of the block that a chunk belongs to, read once a frame."""
        number = seq // EARLY_BLOCK
        if number not in blocks:
            stored = self.early.getValue((number,)) if self.early.containsKey((number,)) else ("[]",)
            blocks[number] = {n: tuple(chunk) for n, chunk in json.loads(stored[0])}
        return blocks[number]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What waited too long is given out as it is, aliases and all: nothing raw leaves with a gap before it."""
        following, tail, waiting, _ = self.place.get()
        out = [(key[0], following, "Expired", tail)] if tail else []
        if waiting:
            early = sorted((n, delta) for _, stored in self.early.iterator() for n, (event, delta) in json.loads(stored[0]) if n >= following)
            out += [(key[0], seq, "Expired", delta) for seq, delta in early]
        self._forget()
        yield pd.DataFrame(out, columns=["msg_id", "seq", "event", "emitted"])

    def _forget(self) -> None:
        self.place.clear()
        self.reverse.clear()
        self.early.clear()

    def close(self) -> None:
        pass


class CarryGroups(StatefulProcessor):
    """What `CarryState` keeps, for a group of responses that never expire.

    A key by itself costs frames, and every call to the state's server far more than a chunk, so responses share keys,
    and some of them a page: the chunk that comes next, the held-back tail, the alias map and the early chunks of the
    next one's block.  Early chunks of later blocks are in `early`, so a long response does not weigh on its page.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page int", "responses string")
        self.early = handle.getMapState("early", "msg_id string, block int", "chunks string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        ended: set[str | None] = set()
        for frame in rows:
            arrived: dict[str | None, list[tuple]] = {}
            for msg, *chunk in zip(*(frame[c].tolist() for c in ("msg_id", "seq", "event", "delta", "reverse"))):
                arrived.setdefault(msg, []).append(chunk)
            pages: dict[int, list[str | None]] = {}
            for msg in arrived:
                # A chunk that comes behind the end of its response says nothing new.
                if msg not in ended:
                    pages.setdefault(zlib.crc32((msg or "").encode()) % CARRY_PAGES, []).append(msg)
            out: list[tuple] = []
            for page, msgs in pages.items():
                known = self.pages.containsKey((page,))
                held = {msg: state for msg, *state in json.loads(self.pages.getValue((page,))[0])} if known else {}
                for msg in msgs:
                    state = self._taken(msg, arrived[msg], held.pop(msg, (MAP_SEQ, "", 0, [], [])), out)
                    if state:
                        held[msg] = state
                    else:
                        ended.add(msg)
                if held:
                    self.pages.updateValue((page,), (json.dumps([(msg, *state) for msg, state in held.items()]),))
                elif known:
                    self.pages.removeKey((page,))
            yield pd.DataFrame(out, columns=["msg_id", "seq", "event", "emitted"])

    def _taken(self, msg: str | None, chunks: list[tuple], state: tuple, out: list[tuple]) -> tuple | None:
        """Add what the chunks of a response let out; what is kept of it, none behind its end."""
        following, tail, later, pairs, near = state
        pairs, near = dict(pairs), dict(near)
        arrived = {int(seq): chunk for seq, *chunk in chunks if seq >= following}
        done = False
        while not done:
            if following in arrived:
                event, delta, given = arrived.pop(following)
            elif following in near:
                (event, delta), given = near[following], None
            else:
                break
            near.pop(following, None)
            if following == MAP_SEQ:
                pairs = {pair["alias"]: pair["raw"] for pair in given} if given is not None else {}
            else:
                emitted, tail, done = _carried(event, delta, tail, pairs)
                out.append((msg, following, event, emitted))
            following += 1
            if later and following and following % EARLY_BLOCK == 0 and self.early.containsKey((msg, following // EARLY_BLOCK)):
                near = dict(json.loads(self.early.getValue((msg, following // EARLY_BLOCK))[0]))
                self.early.removeKey((msg, following // EARLY_BLOCK))
                later -= 1
        if done:
            if later:
                # Chunks far behind the end of their response.
                for place in [place for place in self.early.keys() if place[0] == msg]:
                    self.early.removeKey(place)
            return None
        blocks: dict[int, dict[int, tuple]] = {}
        for seq, (event, delta, _) in arrived.items():
            number = seq // EARLY_BLOCK
            block = near if number <= max(following, 0) // EARLY_BLOCK else blocks.setdefault(number, {})
            block.setdefault(seq, (event, delta))
        for number, block in blocks.items():
            if later and self.early.containsKey((msg, number)):
                block |= dict(json.loads(self.early.getValue((msg, number))[0]))
            else:
                later += 1
            self.early.updateValue((msg, number), (json.dumps(list(block.items())),))
        return following, tail, later, list(pairs.items()), list(near.items())

    def close(self) -> None:
        pass


def _carried(event: str, delta: str, tail: str, pairs: dict[str, str]) -> tuple[str, str, bool]:
    """(text given out, tail held back, was it the last chunk) of one chunk."""
    if event != "Token":
        return (tail if event == "Done" else ""), "", True
    text = tail + delta
    at = text.rfind(LEFT)
    cut = len(text) if at < 0 or RIGHT in text[at:] else at
    out = text[:cut]
    for alias, raw in pairs.items():
        out = out.replace(alias, raw)
    return out, text[cut:], False


def stream_rehydrate(chunks: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """Restore a chunk stream (msg_id, seq, event, delta, reverse array<struct<alias, raw>>).

    A response's alias map comes once, in a row with seq -1 (event `Map`), and stays in state; chunks
    are numbered from 0.  A chunk that comes before one of its predecessors, or before the map, waits in
    state, over as many micro-batches as it takes; one that comes again is passed over.  `Done` and
    `Error` end a response and free its state.  With `patience_ms` the stream needs a watermark: a
    response without a new chunk for so long in event time is given out as it is, as `Expired`.  Timers belong to
    keys, so responses share keys only without it.
    """
    if patience_ms is None:
        group = F.pmod(F.xxhash64("msg_id"), F.lit(CARRY_GROUPS)).cast("int")
        keyed, state = chunks.withColumn("__group", group).groupBy("__group"), CarryGroups()
    else:
        keyed, state = chunks.groupBy("msg_id"), CarryState(patience_ms)
    return keyed.transformWithStateInPandas(
        statefulProcessor=state, outputMode="Append", timeMode="None" if patience_ms is None else "EventTime",
        outputStructType="msg_id string, seq int, event string, emitted string")


class ChainState(StatefulProcessor):
    """Head of one hash chain; rows are signed in the order of their batch, time and number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "sig string")
        self.held = handle.getMapState("held", "part int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        prev = self.head.get()[0] if self.head.exists() else GENESIS
        for frame in in_order(rows, ["ts", "seq"], self.held):
            before, sigs = [], []
            for values in frame[["ts", "kind", "raw_hash", "alias", "action"]].itertuples(index=False, name=None):
                before.append(prev)
                prev = sign(prev, tuple(None if v is None or v != v else v for v in values))
                sigs.append(prev)
            yield frame.assign(prev_hash=before, sig=sigs)[
                ["chain_id", "ts", "seq", "kind", "raw_hash", "alias", "action", "prev_hash", "sig"]]
        self.head.update((prev,))

    def close(self) -> None:
        pass


def stream_audit_chain(rows: DataFrame, chain_key: str, seq: str = "seq", shards: int = CHAIN_SHARDS) -> DataFrame:
    """Sign a stream of audit rows (chain_key, seq, ts, kind, raw_hash, alias, action) into hash chains.

    The chains are those of `audit_chain` over rows that arrive in the order of time; state is the last
    signature of each chain, and no list of a chain is held.
    """
    placed = placed_in_chains(rows, chain_key, seq, shards)
    return (placed.select("chain_id", "ts", F.col(seq).cast("long").alias("seq"), "kind", "raw_hash", "alias", "action")
            .groupBy("chain_id").transformWithStateInPandas(
                statefulProcessor=ChainState(), outputMode="Append", timeMode="None",
                outputStructType=("chain_id string, ts string, seq bigint, kind string, raw_hash string, alias string, "
                                  "action string, prev_hash string, sig string")))


def stream_late_scan(late: DataFrame, sent: DataFrame, within: str = "10 minutes", delay: str = "1 hour",
                     msg: str = "msg_id") -> DataFrame:
    """Audit the spans that a second pass finds after a message was sent.

    `late` is a stream (msg, found_at, spans), `sent` one of what left (msg, sent_at, spans).  A late list
    is joined with its message if it was found at most `within` after the sending; lists that arrive
    again count once, and spans that overlap one the message was sent with are no news.  Gives (msg,
    found_at, status, start, kind, raw_hash, alias, action, source): `audited` rows as the batch form
    writes them, and one `unmatched` row, with nulls, for a list without a message in time, once the
    watermarks (`delay` behind the newest row) are past it.
    """
    once = (late.withColumn("__list", F.xxhash64("spans")).withWatermark("found_at", delay)
            .dropDuplicatesWithinWatermark([msg, "__list"]).select(F.col(msg), "found_at", F.col("spans").alias("__late")))
    known = sent.withWatermark("sent_at", delay).select(F.col(msg).alias("__msg"), "sent_at", F.col("spans").alias("__sent"))
    near = ((F.col(msg) == F.col("__msg")) & (F.col("found_at") >= F.col("sent_at"))
            & (F.col("found_at") <= F.col("sent_at") + F.expr(f"interval {within}")))
    joined = once.join(known, near, "leftOuter")
    news = F.filter("__late", lambda s: ~F.exists("__sent", lambda p: (p["start"] < s["end"]) & (s["start"] < p["end"])))
    entry = F.transform(news, lambda s: F.struct(
        F.lit("audited").alias("status"), s["start"].alias("start"), s["kind"].alias("kind"),
        F.sha2(s["raw"], 256).alias("raw_hash"), s["alias"].alias("alias"), F.lit("PARANOID").alias("action"), F.lit("llm").alias("source")))
    nothing = F.array(F.struct(F.lit("unmatched").alias("status"), F.lit(None).cast("int").alias("start"), *[
        F.lit(None).cast("string").alias(c) for c in ("kind", "raw_hash", "alias", "action", "source")]))
    rows = F.when(F.col("__msg").isNull(), nothing).otherwise(entry)
    return joined.select(msg, "found_at", F.explode(rows).alias("__row")).select(msg, "found_at", "__row.*")


def stream_audit_metrics(audit: DataFrame, window: str = "24 hours", slide: str = "1 hour",
                         late: str = "1 hour") -> DataFrame:
    """Windowed ALIAS and BLOCK counts of an audit stream with an event-time column `ts`.

    Sliding windows of 24 hours and of 7 days are two calls; state is one row per window, with its kinds.
    """
    return (audit.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"))
            .agg(F.count_if(F.col("action") == "ALIAS").alias("redactions"),
                 F.count_if(F.col("action") == "BLOCK").alias("blocks"),
                 F.array_sort(F.collect_set("kind")).alias("kinds"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "redactions", "blocks", F.size("kinds").alias("classes")))


def stream_audit_totals(audit: DataFrame) -> DataFrame:
    """Lifetime counts by action and kind, kept current; for update or complete output.

    State is one row for each action and kind, at most some 200, so it needs no watermark.
    """
    return audit.groupBy("action", "kind").agg(F.count("*").alias("rows"))
