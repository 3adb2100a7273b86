"""Per-message and per-response measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.operators.policy import first_critical_sql


def message_trace(df: DataFrame, msg: str = "msg_id", text: str = "text",
                  detector_status: str = "'not_loaded'", model_spans: str | None = None, model: str = "model_id",
                  provider: str = "provider") -> DataFrame:
    """One row per message from the stage lists of `detect_all(stages=True)`.  Row by row.

    `model` and `provider` say where the message goes; a column that is missing is given as NULL.
    """
    def given(name: str):
        return F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name)
    return df.select(
        msg, F.expr(f"octet_length({text})").alias("text_len"),
        F.size("spans_pattern").alias("pattern_spans"), F.size("spans_structured").alias("structured_spans"),
        F.size("spans_watchlist").alias("watchlist_spans"), F.size("spans").alias("merged_spans"),
        (F.size(model_spans) if model_spans else F.lit(0)).alias("model_spans"), given(model), given(provider),
        F.expr(detector_status).alias("detector_status"),
        F.expr(f"{first_critical_sql('spans')}.kind").alias("blocked_kind"), "text_aliased")


def stream_trace(chunks: DataFrame, restored: DataFrame, msg: str = "msg_id") -> DataFrame:
    """Per response: time to first token, duration, size, both texts and the error.

    `chunks` has (msg, seq, event, delta, at_ms since dispatch); `restored` is the output of
    `rehydrate_chunks`.  The texts are put together inside each response.
    """
    token, error = F.col("event") == "Token", F.col("event") == "Error"
    part = F.when(token, F.struct("seq", "delta"))
    totals = chunks.groupBy(msg).agg(
        F.min(F.when(token, F.col("at_ms"))).alias("ttft_ms"), F.max("at_ms").alias("total_stream_ms"),
        F.count_if(token).alias("chunks"),
        F.coalesce(F.sum(F.when(token, F.octet_length("delta"))), F.lit(0)).alias("bytes"),
        F.sort_array(F.collect_list(part)).alias("__parts"),
        F.max(F.when(error, F.col("delta"))).alias("error"))
    texts = restored.groupBy(msg).agg(F.sort_array(F.collect_list(F.struct("seq", "emitted"))).alias("__out"))
    return totals.join(texts, msg, "left").select(
        msg, "ttft_ms", "total_stream_ms", "chunks", "bytes",
        F.expr("array_join(transform(__parts, p -> p.delta), '')").alias("response_aliased"),
        F.expr("coalesce(array_join(transform(__out, p -> p.emitted), ''), '')").alias("response_restored"),
        "error")


def mean_ttft(traces: DataFrame) -> DataFrame:
    """Rounded mean over the responses that produced a token; NULL when there are none."""
    return traces.agg(F.expr("cast(floor(avg(ttft_ms) + 0.5) as bigint)").alias("mean_ttft_ms"))


def attach_late_trace(sent: DataFrame, streams: DataFrame, late: DataFrame, msg: str = "msg_id") -> DataFrame:
    """Send trace with its stream and late-scan traces, where they exist."""
    return sent.join(streams, msg, "left").join(late, msg, "left")


def estimate_tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, F.ceil(F.length(text) / 4).cast("long"))
