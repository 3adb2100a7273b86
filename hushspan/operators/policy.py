"""What may leave: blocking, routing, payload preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.functions import arrays as A
from hushspan.kinds import BLOCK_POLICY, CRITICAL_KINDS, sql_list, sql_map
from hushspan.operators.alias import alias_local_sql, rewrite_sql
from hushspan.operators.scan import computed

# ---- Fixed values: model routing -----------------------------------------------------------------
MODEL_PROVIDERS = {
    "gpt-5": "openai", "gpt-5-mini": "openai", "o4": "openai",
    "claude-opus-4": "anthropic", "claude-sonnet": "anthropic", "claude-haiku": "anthropic",
    "gemini-2-5-pro": "google", "gemini-flash": "google", "grok-4": "xai",
}
ROUTE_PREFIXES = {"openrouter:": "openrouter", "ollama:": "ollama"}
LOOPBACK_HOSTS = ("localhost", "127.0.0.1", "::1")
ROLE_LABELS = {"system": "System", "assistant": "Assistant"}
# ---- end of the fixed values -----------------------------------------------------------------------

# Name of the model that runs on the device itself; set it to what your deployment calls it.
ON_DEVICE_MODEL = "on-device"


def first_critical_sql(spans: str) -> str:
    s = A.name("s")
    return f"get(filter({spans}, {s} -> {s}.kind IN ({sql_list(CRITICAL_KINDS)})), 0)"


def block_decision(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Add `blocked` and `blocked_kind`, the first critical kind by position.  Row by row."""
    return (df.withColumn("blocked_kind", F.expr(f"{first_critical_sql(spans)}.kind"))
            .withColumn("blocked", F.col("blocked_kind").isNotNull()))


def block_policy(df: DataFrame, kind: str = "blocked_kind") -> DataFrame:
    """Add rule, class and description for a critical kind (NULL for others)."""
    for i, name in enumerate(("rule", "class", "description")):
        df = df.withColumn(name, F.expr(sql_map(kind, {k: v[i] for k, v in BLOCK_POLICY.items()})))
    return df


def provider_sql(model: str, on_device: str = ON_DEVICE_MODEL) -> str:
    prefixes = " ".join(f"WHEN startswith({model}, '{p}') THEN '{v}'" for p, v in ROUTE_PREFIXES.items())
    return (f"CASE WHEN {model} = '{on_device}' THEN 'local' {prefixes} "
            f"ELSE {sql_map(model, MODEL_PROVIDERS)} END")


def route_model(df: DataFrame, model: str = "model_id", on_device: str = ON_DEVICE_MODEL) -> DataFrame:
    """Add `provider`; an unknown model gives NULL and `routable` false."""
    return (df.withColumn("provider", F.expr(provider_sql(model, on_device)))
            .withColumn("routable", F.col("provider").isNotNull()))


def endpoint_host_sql(url: str) -> str:
    rest = f"if(contains({url}, '://'), substr({url}, instr({url}, '://') + 3), {url})"
    authority = f"regexp_extract({rest}, '^([^/?#]*)', 1)"
    hostport = f"substring_index({authority}, '@', -1)"
    return A.let(hostport, lambda h: (
        f"if(startswith({h}, '['), substring_index(substr({h}, 2), ']', 1), substring_index({h}, ':', 1))"))


def is_local_endpoint_sql(url: str) -> str:
    return f"coalesce({endpoint_host_sql(url)} IN ({sql_list(LOOPBACK_HOSTS)}), false)"


def classify_endpoint(df: DataFrame, url: str = "base_url") -> DataFrame:
    """Add `is_local`; anything that is not clearly loopback counts as remote."""
    return df.withColumn("is_local", F.expr(is_local_endpoint_sql(url)))


def egress_decision(df: DataFrame, model: str = "model_id", base_url: str = "base_url", spans: str = "spans",
                    on_device: str = ON_DEVICE_MODEL) -> DataFrame:
    """Add `egress` and what it follows from; aliases are not needed, so it comes before minting."""
    df = block_decision(route_model(df, model, on_device), spans)
    local = f"({model} = '{on_device}' OR (startswith({model}, 'ollama:') AND {is_local_endpoint_sql(base_url)}))"
    df = df.withColumn("is_local", F.expr(local))
    df = df.withColumn("blocked", F.col("blocked") & ~F.col("is_local"))
    df = df.withColumn("blocked_kind", F.when(F.col("blocked"), F.col("blocked_kind")))
    status = (F.when(F.col("blocked"), "blocked").when(F.col("is_local"), "sent_raw")
              .when(F.col("routable"), "sent_aliased").otherwise("no_provider"))
    return df.withColumn("egress", status)


def egress_payload(df: DataFrame, model: str = "model_id", base_url: str = "base_url", text: str = "text",
                   aliased: str = "text_aliased", spans: str = "spans",
                   on_device: str = ON_DEVICE_MODEL) -> DataFrame:
    """Add what is sent: raw text locally, aliased text remotely, nothing when blocked."""
    df = egress_decision(df, model, base_url, spans, on_device)
    payload = (F.when(F.col("egress") == "sent_raw", F.col(text)).when(F.col("egress") == "sent_aliased", F.col(aliased)))
    return df.withColumn("payload", payload)


def content_text_sql(content: str) -> str:
    """Text of a chat content value in JSON: a text, or a list of parts with `text`."""
    p = A.name("p")
    parts = (f"array_join(filter(transform(from_json({content}, 'array<struct<text:string>>'), "
             f"{p} -> {p}.text), {p} -> {p} IS NOT NULL), {A.lit(chr(10))})")
    plain = f"from_json(concat('{{\"v\":', {content}, '}}'), 'struct<v:string>').v"
    return (f"coalesce(CASE WHEN startswith({content}, '[') THEN {parts} "
            f"WHEN startswith({content}, '\"') THEN {plain} ELSE '' END, '')")


def flatten_messages(turns: DataFrame, request: str = "request_id", position: str = "turn",
                     role: str = "role", content: str = "content") -> DataFrame:
    """One prompt per request: `Role: content` blocks in order, empty ones left out."""
    labelled = (turns
                .select(request, F.col(position).alias("p"), F.expr(sql_map(role, ROLE_LABELS, "'User'")).alias("l"),
                        F.expr(content_text_sql(content)).alias("c"))
                .filter(F.col("c") != ""))
    lists = labelled.groupBy(request).agg(F.sort_array(F.collect_list(F.struct("p", "l", "c"))).alias("__t"))
    joined = F.expr(f"array_join(transform(__t, t -> concat(t.l, ': ', t.c)), {A.lit(chr(10) * 2)})")
    return lists.select(request, F.regexp_replace(joined, r"(?U)\s+\z", "").alias("text"))


def prepare_payload(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Alias a flat prompt with a fresh scope and decide whether it may go.  Row by row."""
    df = computed(df, spans, alias_local_sql(spans))
    df = computed(df, "text_aliased", rewrite_sql(text, spans))
    return block_policy(block_decision(df, spans))


def fan_out(df: DataFrame, models: list[str]) -> DataFrame:
    """One row per prompt and model; the models are a short configured list, so no join is needed."""
    items = ", ".join(f"named_struct('model_no', {i}, 'model_id', '{m}')" for i, m in enumerate(models))
    return df.select("*", F.expr(f"inline(array({items}))"))
