"""Reading and writing the stored tables: messages, conversations, settings, corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushspan.functions import arrays as A
from hushspan.kinds import SPANS_TYPE, TOGGLEABLE_PACKS

CONVERSATION_LIMIT = 200  # fixed value: the listing shows the newest 200
CORPUS_SCHEMA = ("version int, prompts array<struct<id:string,text:string,"
                 "expected:array<struct<kind:string,raw:string>>,semantic_only:boolean,note:string>>")


BUCKETS = 64


def bucket_of(conv_id) -> Column:
    """The partition that `write_messages` puts a conversation in."""
    return F.pmod(F.xxhash64(conv_id), F.lit(BUCKETS))


def read_messages(messages: DataFrame, conv_id: str | None = None) -> DataFrame:
    """Messages by conversation and time; with an id, only that conversation's partition is read."""
    if conv_id is not None:
        found = messages.filter(F.col("conv_id") == conv_id)
        if "conv_bucket" in messages.columns:
            # The bucket is a constant, so the scan is pruned to one folder.
            found = found.filter(F.col("conv_bucket") == bucket_of(F.lit(conv_id)).cast("int"))
        return found.orderBy("created_at")
    return messages.orderBy("conv_id", "created_at")


def list_conversations(conversations: DataFrame, messages: DataFrame,
                       limit: int = CONVERSATION_LIMIT) -> DataFrame:
    """Newest conversations and whether any of their messages has spans.

    The top-k comes first, so only those conversations look for shielded messages.
    """
    newest = conversations.orderBy(F.col("created_at").desc(), "id").limit(limit)
    shielded = (messages.filter(F.col("spans_json") != "[]").select(F.col("conv_id").alias("id"))
                .join(newest.select("id"), "id", "left_semi").distinct()
                .withColumn("__hit", F.lit(True)))
    return (newest.join(shielded, "id", "left")
            .withColumn("shielded", F.coalesce("__hit", F.lit(False))).drop("__hit"))


def read_eval_corpus(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Prompts of a nested JSON corpus: id, text, expected, semantic_only, note.

    One corpus per line splits over many tasks; `multi_line=True` reads a file with line breaks inside.
    """
    corpus = spark.read.schema(CORPUS_SCHEMA).json(path, multiLine=multi_line)
    prompts = corpus.select(F.explode("prompts").alias("p")).select("p.*")
    return prompts.withColumn("semantic_only", F.coalesce("semantic_only", F.lit(False)))


def expected_spans(prompts: DataFrame) -> DataFrame:
    """Long expected spans (prompt_id, kind, raw) of a corpus."""
    return prompts.select(F.col("id").alias("prompt_id"), F.explode("expected").alias("e")).select(
        "prompt_id", "e.kind", "e.raw")


def load_spans_json(df: DataFrame, column: str = "spans_json", out: str = "spans") -> DataFrame:
    """Stored spans as an array; broken JSON gives none, a missing confidence 1.0."""
    s = A.name("s")
    parsed = f"from_json({column}, '{SPANS_TYPE}')"
    filled = (f"transform({{p}}, {s} -> named_struct('start', {s}.start, 'end', {s}.end, 'kind', {s}.kind,"
              f" 'raw', {s}.raw, 'alias', {s}.alias, 'confidence', coalesce({s}.confidence, cast(1.0 as float))))")
    x = A.name("x")
    complete = (f"forall({{p}}, {x} -> {x}.start IS NOT NULL AND {x}.end IS NOT NULL AND {x}.kind IS NOT NULL"
                f" AND {x}.raw IS NOT NULL AND {x}.alias IS NOT NULL)")
    expr = A.let(parsed, lambda p: f"if({complete.format(p=p)}, {filled.format(p=p)}, NULL)")
    return df.withColumn(out, F.expr(f"coalesce({expr}, cast(array() as {SPANS_TYPE}))"))


def spans_to_json(df: DataFrame, spans: str = "spans", out: str = "spans_json") -> DataFrame:
    return df.withColumn(out, F.to_json(spans))


def write_messages(df: DataFrame, path: str) -> None:
    """Append raw text, aliased text and spans together, partitioned by a bucket of the conversation.

    Rows are dealt by bucket first, so a task writes few files; the rebalance lets Spark split a large
    bucket over several tasks.
    """
    rows = spans_to_json(df).withColumn("conv_bucket", bucket_of("conv_id").cast("int"))
    (rows.hint("rebalance", "conv_bucket").select("msg_id", "conv_id", "role", "text_raw", "text_aliased", "spans_json", "created_at", "conv_bucket")
     .write.mode("append").partitionBy("conv_bucket").parquet(path))


def latest_settings(changes: DataFrame, key: str = "key", value: str = "value", order: str = "seq") -> DataFrame:
    """Last value of each key; `max_by` combines map-side, so a busy key is no hot task."""
    return changes.groupBy(key).agg(F.max_by(value, order).alias(value))


def setting_list(settings: DataFrame, key: str) -> DataFrame:
    """Items of one setting that holds a JSON list of texts; a malformed value gives no rows."""
    rows = settings.filter(F.col("key") == key)
    others = [c for c in settings.columns if c not in ("key", "value")]
    items = F.expr("explode_outer(from_json(value, 'array<string>')) as item")
    return rows.select(*others, items).filter("item IS NOT NULL")


def read_watchlist(settings: DataFrame) -> DataFrame:
    return setting_list(settings, "custom_watchlist")


def read_disabled_packs(settings: DataFrame) -> DataFrame:
    """Disabled packs, without any that may never be switched off."""
    return setting_list(settings, "disabled_packs").filter(F.col("item").isin(*TOGGLEABLE_PACKS))
