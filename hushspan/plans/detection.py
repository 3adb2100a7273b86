"""Registered queries for detection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushspan.functions import spanscorer
from hushspan.functions.digests import md5_heads
from hushspan.operators import candidates as N
from hushspan.operators import merge as M
from hushspan.operators import scan as S
from hushspan.operators import structured as T
from hushspan.operators import windows as X
from hushspan.operators.audit import audit_rows
from hushspan.operators.policy import block_decision
from hushspan.operators.termindex import detect_terms
from hushspan.operators.watchlist import detect_watchlist
from hushspan.plans import corpus as K
from hushspan.plans import oracle as O

SPAN_COLUMNS = ("start", "end", "kind", "raw", "confidence")
WATCHLIST = ["Project Helios", "Halcyon Labs", "Oak Hill", "Halcyon", "example.com/p", "x"]
DISABLED = ["payment", "network", "core"]
PACKS = {"payment": "payment", "secrets": "secrets", "identity": "identity",
         "national_id": "national-id", "medical": "medical", "legal": "legal",
         "network": "network", "core": "core"}

# Tabular texts made from customers: header, delimiter and rows vary with the key.
_N = "(c_custkey * 7919 + 17)"
_SSN = f"lpad(concat('', ({_N} * 31) % 1000000000), 9, '0')"
_CARD = f"(CASE c_custkey % 3 WHEN 0 THEN '4111111111111111' ELSE concat('4', lpad(concat('', {_N} % 1000000000), 15, '0')) END)"


def _table(header: str, *cells: str) -> str:
    d = header[-1]
    row = f", '{d}', ".join(cells)
    return f"'{header[:-1]}', chr(10), {row}"


TABULAR = f"""
SELECT concat('cust-', c_custkey) AS doc_id, concat('Export of ', c_name, chr(10), CASE c_custkey % 6
  WHEN 0 THEN concat({_table('name,ssn,email,', 'c_name', _SSN, "concat('u', c_custkey, '@example.com')")}, chr(10),
                     {", ',', ".join(["'n/a'", "'000121234'", "' spaced@example.com '"])})
  WHEN 1 THEN concat({_table('Card Number|amount|', _CARD, "c_acctbal")}, chr(10), {_CARD}, '|-')
  WHEN 2 THEN concat({_table('iban;Full Name;password;', "'DE89370400440532013000'", 'c_name', "concat('Zk9!', c_custkey, 'pQ7')")}, chr(10),
                     'broken;row', chr(10), 'a;b;c')
  WHEN 3 THEN concat({_table('vin,owner,', "'1HGCM82633A004352'", 'c_name')}, chr(10), 'x,y,z', chr(10), 'phone,mail', chr(10), '415 555 0142,q@example.com')
  WHEN 4 THEN concat('e-mail', chr(9), 'Date of Birth', chr(10), 'p', c_custkey, '@example.com', chr(9), '1990-01-02', chr(10), chr(10), 'after')
  ELSE concat('email,phone', chr(10), 'no table, but Project Helios and EMP-', lpad(concat('', c_custkey), 5, '0')) END,
  chr(10), 'see Halcyon Labs') AS text
FROM customer"""



def tabular_sql(dialect: str) -> str:
    return f"{TABULAR} UNION ALL {K.texts_sql(dialect)}"


HEADERS = """
SELECT concat(c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN '_' WHEN 1 THEN ' ' ELSE '' END,
  CASE c_custkey % 24 WHEN 0 THEN 'SSN' WHEN 1 THEN 'card-number' WHEN 2 THEN 'iban' WHEN 3 THEN 'Routing'
  WHEN 4 THEN 'account number' WHEN 5 THEN 'BIC' WHEN 6 THEN 'national_insurance' WHEN 7 THEN 'Medicare'
  WHEN 8 THEN 'medical record' WHEN 9 THEN 'Policy Number' WHEN 10 THEN 'driver licence' WHEN 11 THEN 'birthday'
  WHEN 12 THEN 'e-mail' WHEN 13 THEN 'cell' WHEN 14 THEN 'ip.address' WHEN 15 THEN 'home address'
  WHEN 16 THEN 'salary' WHEN 17 THEN 'surname' WHEN 18 THEN 'docket' WHEN 19 THEN 'api key'
  WHEN 20 THEN 'quantity' WHEN 21 THEN 'companies' WHEN 22 THEN 'mac' ELSE 'total' END) AS header
FROM customer"""

TABLE = """
SELECT o_orderkey AS order_id, concat('Name ', o_custkey) AS full_name,
  lpad(concat('', (o_orderkey * 7919) % 1000000000), 9, '0') AS ssn,
  CASE o_orderkey % 3 WHEN 0 THEN '4111 1111 1111 1111' WHEN 1 THEN '-' ELSE concat('4000', o_orderkey) END AS card_number,
  CASE o_orderkey % 4 WHEN 0 THEN 'N/A' ELSE concat(' u', o_custkey, '@example.com ') END AS email,
  concat('Tk7$', o_orderkey, 'zQ') AS api_token, o_orderpriority AS priority
FROM orders"""

# One term for many an order and customer, so the list grows with the tables; case and edges vary.
TERMS = f"""
SELECT concat('ORDER ', o_orderkey) AS term FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT concat(' ref ', o_orderkey, ' ') FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT concat('User', c_custkey, '@Example', c_custkey % 3, '.com') FROM customer
UNION ALL SELECT '{"' UNION ALL SELECT '".join(WATCHLIST)}'"""

SCORES = """
SELECT doc_id, word_start, width, label_idx, max(logit) AS logit, word_start * 6 AS start,
       (word_start + width) * 6 - 1 AS "end", concat('w', word_start, '-', width) AS raw
FROM (SELECT l_orderkey AS doc_id, CAST(l_partkey % 20 AS INT) AS word_start, CAST(1 + l_suppkey % 3 AS INT) AS width,
        CAST(l_linenumber % 6 AS INT) AS label_idx, (l_quantity - 20) / 8 AS logit FROM lineitem) q
GROUP BY doc_id, word_start, width, label_idx"""

# A model's answer about the first words of a turn; some are wrapped in prose, some are cut off.
_ITEMS = """concat('{"start":', 3 + turn % 2, ',"end":', 8, ',"kind":"', CASE conv_id % 4 WHEN 0 THEN 'PERSON'
  WHEN 1 THEN 'organization' WHEN 2 THEN 'Project' ELSE 'THING' END, '"},{"start":', 9, ',"end":', CASE turn % 3 WHEN 0 THEN 15 WHEN 1 THEN 21 ELSE 100000000 END,
  ',"kind":"LOCATION"},{"start":7,"end":7,"kind":"NAME"}')"""
ANSWERS = f"""
SELECT concat('m', conv_id, '-', turn) AS msg_id, concat('é Jamie Torres number ', conv_id, '. ', text) AS text,
  CASE turn % 4 WHEN 0 THEN concat('[', {_ITEMS}, ']') WHEN 1 THEN concat('Here: [', {_ITEMS}, '] done')
  WHEN 2 THEN concat('[', {_ITEMS}, ',{{"start":2,"en') ELSE 'no array' END AS model_output
FROM conversations"""


def _sql(text: str) -> str:
    return text.replace('"end"', "`end`")


def _rows(df: DataFrame, *keys: str) -> DataFrame:
    return S.explode_spans(df).select(*keys, *SPAN_COLUMNS)


def tabular_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    K.load_dealt(spark, sf_dir, "customer", "documents", "pages", "orders")
    return spark.sql(tabular_sql(K.SPARK))


def turn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their resolved pattern spans."""
    return S.detect_patterns(K.turns(spark, sf_dir))


def _scan(pack: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = S.scan_pack(K.texts(spark, sf_dir), [pack])
        return hits.select("doc_id", *SPAN_COLUMNS, "rule_no")
    return query


def resolve_overlaps(spark, sf_dir):
    hits = S.scan_pack(K.turns(spark, sf_dir).select("msg_id", "text"), None)
    return _rows(S.resolve_overlaps(hits, "msg_id"), "msg_id")


def detect_patterns(spark, sf_dir):
    return _rows(S.detect_patterns(K.texts(spark, sf_dir)), "doc_id")


def detect_structured(spark, sf_dir):
    return _rows(T.detect_structured(tabular_texts(spark, sf_dir)), "doc_id")


def classify_columns(spark, sf_dir):
    K.load(spark, sf_dir, "customer")
    headers = spark.sql(HEADERS).groupBy("header").agg(F.count("*").alias("n"))
    return T.classify_columns(headers)


def scan_table_columns(spark, sf_dir):
    K.load(spark, sf_dir, "orders")
    return T.scan_table_columns(spark.sql(TABLE), "order_id")


def watchlist(spark, sf_dir):
    return _rows(detect_watchlist(K.texts(spark, sf_dir), WATCHLIST), "doc_id")


def _digest(*columns: str):
    """Sum of a hash of each row: tells different rows apart whatever their order."""
    return F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("bigint")).alias("digest")


def tokenize_words(spark, sf_dir):
    words = N.explode_words(N.tokenize_words(K.texts(spark, sf_dir)))
    return words.groupBy("doc_id").agg(
        F.count("*").alias("words"), _digest("start", "end", "word"))


#: Number of windows and their digest, for each width.
_SUMS = [f"{column}{width}" for column in ("windows", "digest") for width in range(1, N.MAX_WIDTH + 1)]


def _window_sums(windows: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each text of a batch: count and `_digest` of its windows of every width."""
    doc = windows.column(0)
    rows, (at, width, start, end) = doc.indices.to_numpy(), (c.to_numpy() for c in windows.columns[1:])
    # The rows of a batch come in their order.
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    group = np.repeat(np.arange(len(first)) * N.MAX_WIDTH - 1, np.diff(first, append=len(rows))) + width
    # Exact, as a batch has far fewer than 2^21 windows.
    sums = (np.bincount(group, weights, len(first) * N.MAX_WIDTH).astype(np.int64).reshape(-1, N.MAX_WIDTH)
            for weights in (None, md5_heads(at, start, end)))
    columns = [pa.array(np.ascontiguousarray(column)) for both in sums for column in both.T]
    return pa.RecordBatch.from_arrays([doc.dictionary.take(pa.array(rows[first])), *columns], ["doc_id", *_SUMS])


def candidate_word_spans(spark, sf_dir):
    windows = N.candidate_word_spans(N.tokenize_words(K.texts(spark, sf_dir)), each=_window_sums,
                                     each_type=", ".join(["doc_id string", *(f"{c} long" for c in _SUMS)]))
    sums = windows.groupBy("doc_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS))
    widths = ", ".join(f"{width}, windows{width}, digest{width}" for width in range(1, N.MAX_WIDTH + 1))
    rows = sums.select("doc_id", F.expr(f"stack({N.MAX_WIDTH}, {widths}) as (width, windows, digest)"))
    return rows.where("windows > 0")


def _decoded(spans: DataFrame) -> DataFrame:
    return S.explode_spans(spans).select("doc_id", "start", "end", "kind", "raw",
                                         F.round("confidence", 4).cast("double").alias("confidence"))


def decode_stored_scores(spark, sf_dir):
    K.load(spark, sf_dir, "lineitem")
    return _decoded(N.decode_scored_spans(spark.sql(_sql(SCORES))))


def decode_scored_spans(spark, sf_dir):
    """Windows of all texts scored into a long table, which is decoded text by text."""
    return _decoded(N.decode_scored_spans(X.score_windows(K.texts(spark, sf_dir), spanscorer.default_scorer)))


def detect_windows(spark, sf_dir):
    return _decoded(X.detect_windows(K.texts(spark, sf_dir), spanscorer.default_scorer))


def terms(spark, sf_dir):
    texts = K.texts(spark, sf_dir)
    K.load(spark, sf_dir, "customer", "orders")
    return _rows(detect_terms(texts, spark.sql(TERMS)), "doc_id")


def answers(spark, sf_dir):
    K.load(spark, sf_dir, "conversations")
    return N.ingest_model_spans(spark.sql(ANSWERS))


def ingest_model_spans(spark, sf_dir):
    return _rows(answers(spark, sf_dir), "msg_id")


_SECOND = ("transform(sequence(0, 5), k -> named_struct('start', cast(turn * 7 + k * 11 as int), 'end', "
           "cast(turn * 7 + k * 11 + 8 + k * 3 as int), 'kind', 'ORG_NER', 'raw', concat('w', k), 'alias', '', "
           "'confidence', cast(0.6 as float)))")


def merge_spans(spark, sf_dir):
    df = turn_spans(spark, sf_dir).withColumnRenamed("spans", "first").withColumn("second", F.expr(_SECOND))
    return _rows(M.merge_spans(df, "first", "second").select("msg_id", "spans"), "msg_id")


def filter_packs(spark, sf_dir):
    return _rows(M.filter_packs(turn_spans(spark, sf_dir), DISABLED).select("msg_id", "spans"), "msg_id")


def annotate_spans(spark, sf_dir):
    long = S.explode_spans(turn_spans(spark, sf_dir))
    return M.annotate_spans(long).select("msg_id", "start", "kind", "label", "pack", "tier", "source")


def detect_all(spark, sf_dir):
    df = M.detect_all(tabular_texts(spark, sf_dir), watchlist=WATCHLIST, disabled_packs=["identity"])
    return _rows(df, "doc_id")


def _helios(texts: list[str]):
    if any("wallet" in text for text in texts):
        raise ValueError("no wallets")
    if any("jwt " in text for text in texts):
        raise N.NotLoaded("model file")
    places = [text.find("Helios") for text in texts]
    return [[(at, at + 6, "CODENAME_NER", 0.75)] if at >= 0 else [] for at in places]


def with_detector(spark, sf_dir):
    found = N.with_detector(K.turns(spark, sf_dir).select("msg_id", "text"), _helios, "msg_id", timeout_ms=60_000)
    return found.select("msg_id", "status", "error", F.expr("get(spans, 0).start").alias("start"),
                        F.expr("get(spans, 0).raw").alias("raw"))


def late_scan(spark, sf_dir):
    sent = block_decision(turn_spans(spark, sf_dir)).filter("NOT blocked").select("msg_id")
    late = answers(spark, sf_dir).join(sent, "msg_id").withColumn("ts", F.lit("")).withColumn("blocked", F.lit(False))
    return audit_rows(late, mode="late").select("msg_id", "seq_in_msg", "kind", "raw_hash", "alias", "action", "source")


def revalidate_spans(spark, sf_dir):
    stored = S.explode_spans(turn_spans(spark, sf_dir)).select("msg_id", "start", "end", "kind", "raw")
    edited = K.turns(spark, sf_dir).withColumn("text", F.expr(
        "CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN concat('+', text) ELSE left(text, length(text) - 20) END"))
    return N.revalidate_spans(stored, edited, "msg_id")


QUERIES = {f"scan_{name}": _scan(pack) for name, pack in PACKS.items()} | {
    "resolve_overlaps": resolve_overlaps, "detect_patterns": detect_patterns,
    "detect_structured": detect_structured, "classify_columns": classify_columns,
    "scan_table_columns": scan_table_columns, "detect_watchlist": watchlist,
    "tokenize_words": tokenize_words, "candidate_word_spans": candidate_word_spans,
    "decode_scored_spans": decode_scored_spans, "decode_stored_scores": decode_stored_scores,
    "detect_windows": detect_windows, "detect_terms": terms, "ingest_model_spans": ingest_model_spans,
    "merge_spans": merge_spans, "filter_packs": filter_packs, "annotate_spans": annotate_spans,
    "detect_all": detect_all, "with_detector": with_detector, "late_scan": late_scan,
    "revalidate_spans": revalidate_spans,
}

# ---- expected results in DuckDB ------------------------------------------------------------------
_TEXTS = f"texts AS MATERIALIZED ({K.texts_sql(K.DUCKDB)})"
TURN_CTES = (f"turns AS MATERIALIZED ({K.turns_sql(K.DUCKDB)}), {O.hits_ctes('turns', 'msg_id')}, "
             f"{O.spans_ctes('msg_id')}")
_SPAN = f'"start", "end", kind, raw, {O.confidence()} AS confidence'
_EMPTY = "('', 'null', 'none', 'n/a', 'na', 'nil', '-', '--', 'unknown', 'tbd')"


def _header_case(cell: str) -> str:
    plain = f"regexp_replace(lower(trim({cell})), '[^a-z0-9]', ' ', 'g')"
    whens = []
    for kind, words, parts in T.HEADERS:
        tests = [f"list_contains(string_split({plain}, ' '), '{w}')" for w in words.split()]
        tests += [f"contains({plain}, '{p}')" for p in parts]
        whens.append(f"WHEN {' OR '.join(tests)} THEN '{kind}'")
    return f"CASE {' '.join(whens)} END"


def _checked(kind: str, raw: str) -> str:
    """CUSTOM for an invalid value of a blocking kind; needs columns kind, d and dl."""
    return f"CASE WHEN {O.critical(kind)} AND NOT ({O.valid_sql(raw)}) THEN 'CUSTOM' ELSE {kind} END"


_DIGITS = ("regexp_replace(raw, '[^0-9]', '', 'g') AS d, list_transform(string_split(regexp_replace(raw, "
           "'[^0-9]', '', 'g'), ''), lambda c: TRY_CAST(c AS INT)) AS dl")


def structured_ctes(source: str) -> str:
    options = []
    for rank, delim in enumerate(T.DELIMITERS):
        d = "chr(9)" if delim == "\t" else f"'{delim}'"
        options.append(f"SELECT doc_id, i, {rank} AS rank, {d} AS delim, string_split(line, {d}) AS cells "
                       f"FROM lines WHERE contains(line, {d})")
    return f"""
lines AS MATERIALIZED (
  SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS off
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {source}))),
headers AS MATERIALIZED (
  SELECT doc_id, i, delim, cells FROM ({' UNION ALL '.join(options)})
  WHERE len(list_filter(cells, lambda c: trim(c) = '' OR strlen(trim(c)) > 40 OR contains(c, '@'))) = 0
    AND len(list_filter(cells, lambda c: ({_header_case('c')}) IS NOT NULL)) > 0
  QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY rank) = 1),
line_walk AS (
  SELECT l.doc_id, l.i, CASE WHEN h.i IS NULL THEN 0 ELSE 1 END AS hi, false AS data
  FROM lines l LEFT JOIN headers h USING (doc_id, i) WHERE l.i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN same THEN hi WHEN is_header THEN i ELSE 0 END, same
  FROM (SELECT l.doc_id, l.i, w.hi, n.i IS NOT NULL AS is_header,
          h.i IS NOT NULL AND len(string_split(l.line, h.delim)) = len(h.cells) AND trim(l.line) <> '' AS same
        FROM line_walk w JOIN lines l ON l.doc_id = w.doc_id AND l.i = w.i + 1
        LEFT JOIN headers h ON h.doc_id = w.doc_id AND h.i = w.hi
        LEFT JOIN headers n ON n.doc_id = l.doc_id AND n.i = l.i)),
cells AS (
  SELECT doc_id, i, off, c, cell, header, coalesce(sum(length(cell) + 1) OVER (PARTITION BY doc_id, i ORDER BY c
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before
  FROM (SELECT l.doc_id, l.i, l.off, unnest(string_split(l.line, h.delim)) AS cell, unnest(h.cells) AS header,
               generate_subscripts(h.cells, 1) AS c
        FROM line_walk w JOIN lines l USING (doc_id, i) JOIN headers h ON h.doc_id = w.doc_id AND h.i = w.hi
        WHERE w.data)),
found AS MATERIALIZED (SELECT *, {_DIGITS} FROM (
  SELECT doc_id, {_header_case('header')} AS kind, trim(cell) AS raw,
         (off + before + length(cell) - length(ltrim(cell)))::INT AS "start" FROM cells)
  WHERE kind IS NOT NULL AND lower(raw) NOT IN {_EMPTY}),
structured AS MATERIALIZED (SELECT doc_id, "start", ("start" + length(raw))::INT AS "end", {_checked('kind', 'raw')} AS kind,
  raw, 0.9::FLOAT AS confidence FROM found)"""


def watch_ctes(source: str, more: str = "") -> str:
    pattern = rf"(?i)(\b(?:{more}Project Helios|example\.com/p|Halcyon Labs|Oak Hill|Halcyon)\b)"
    return f"""
wtagged AS MATERIALIZED (SELECT doc_id, 0 AS ord, 'CUSTOM' AS kind, regexp_replace(text, {O.q(pattern)},
  '{O.OPEN}\\1{O.CLOSE}', 'g') AS tagged FROM {source} WHERE regexp_matches(text, {O.q(pattern)})),
watch AS MATERIALIZED (SELECT doc_id, "start", "end", kind, raw, 1.0::FLOAT AS confidence
  FROM ({O.located_sql('wtagged', 'doc_id')}))"""


def merged_ctes(source: str, off: str = "nothing", terms: str = "SELECT * FROM watch", l1: str = "", packs: str = "") -> str:
    """CTEs l1, structured, watch and merged: all detectors over `source` (doc_id, text), one pack switched off.

    `l1` may choose other pattern spans, `packs` may say for a structured span which pack is off.
    """
    l1 = l1 or f"SELECT * FROM spans WHERE {O.pack()} <> '{off}'"
    packs = packs or f"'{off}'"
    return f"""
{O.hits_ctes(source, 'doc_id')}, {O.spans_ctes('doc_id')}, {structured_ctes(source)}, {watch_ctes(source)},
l1 AS MATERIALIZED (SELECT doc_id, {_SPAN} FROM ({l1})),
l2 AS MATERIALIZED (SELECT * FROM l1 UNION ALL SELECT * FROM structured s WHERE {O.pack()} <> {packs} AND NOT EXISTS (
  SELECT 1 FROM l1 WHERE l1.doc_id = s.doc_id AND l1."start" < s."end" AND s."start" < l1."end")),
merged AS MATERIALIZED (SELECT * FROM l2 UNION ALL SELECT * FROM ({terms}) s WHERE NOT EXISTS (
  SELECT 1 FROM l2 WHERE l2.doc_id = s.doc_id AND l2."start" < s."end" AND s."start" < l2."end"))"""


def _hash_sum(*columns: str) -> str:
    return f"sum(('0x' || substr(md5(concat_ws('|', {', '.join(columns)})), 1, 8))::BIGINT)::BIGINT AS digest"


_W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_WORD = rf"({_W}+(?:[-_]{_W}+)*|[^\s])"


def word_ctes(source: str) -> str:
    return f"""
tagged AS MATERIALIZED (SELECT doc_id, 0 AS ord, '' AS kind, regexp_replace(text, {O.q(_WORD)},
  '{O.OPEN}\\1{O.CLOSE}', 'g') AS tagged FROM {source}),
words AS MATERIALIZED (SELECT doc_id, "start", "end", raw AS word,
  row_number() OVER (PARTITION BY doc_id ORDER BY "start") AS i FROM ({O.located_sql('tagged', 'doc_id')}))"""


_PROB = "(1 / (1 + exp(-logit::DOUBLE)))::FLOAT AS prob"


def window_ctes() -> str:
    """CTE c: windows of 1 to 12 words of CTE words with the scores of the linear scorer, from running sums."""
    shape = "CASE " + " ".join(f"WHEN regexp_matches(word, '{p}') THEN '{n}'" for n, p in spanscorer.SHAPES if p) + " ELSE 'other' END"

    def case(column: str, values: dict, rest: int) -> str:
        whens = "".join(f" WHEN {column} = '{k}' THEN {v}" for k, v in values.items())
        return f"(CASE WHEN {column} IS NULL THEN 0{whens} ELSE {rest} END)"
    labels = list(enumerate(spanscorer.LABELS))
    sums = ", ".join(f"sum({case('shape', label.inside, -30)}) OVER w AS s{n}" for n, label in labels)
    lead = ", ".join(f"{label.bias} + {case('prev', label.before, 0)} + {case('low', label.first, 0)} - s{n} + {case('shape', label.inside, -30)} AS f{n}"
                     for n, label in labels)
    tail = ", ".join(f"s{n} + {case('low', label.last, 0)} AS t{n}" for n, label in labels)
    scores = " UNION ALL ".join(
        f"""SELECT a.doc_id, a.i AS word_start, b.i - a.i + 1 AS width, {n} AS label_idx, (a.f{n} + b.t{n}) / 4 AS logit, a."start", b."end"
  FROM ends a, range(0, 12) k(k) JOIN ends b ON b.doc_id = a.doc_id AND b.i = a.i + k WHERE a.f{n} + b.t{n} > 0""" for n, _ in labels)
    return f"""
shaped AS (SELECT doc_id, i, "start", "end", word, {shape} AS shape, lower(word) AS low, lag(lower(word)) OVER (PARTITION BY doc_id ORDER BY i) AS prev
  FROM words),
ran AS (SELECT *, {sums} FROM shaped WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ends AS MATERIALIZED (SELECT doc_id, i, "start", "end", {lead}, {tail} FROM ran),
c AS MATERIALIZED (SELECT q.*, substr(t.text, q."start" + 1, q."end" - q."start") AS raw, {_PROB} FROM ({scores}) q JOIN texts t USING (doc_id))"""


# From CTE c, with a place for each window: the greedy walk, best first.
_DECODED = """
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, word_start, width, label_idx) AS rn
  FROM c WHERE prob > 0.5),
w AS (
  SELECT doc_id, rn, true AS kept, [{'s': "start", 'e': "end"}] AS acc FROM r WHERE rn = 1
  UNION ALL
  SELECT doc_id, rn, free, CASE WHEN free THEN list_append(acc, {'s': "start", 'e': "end"}) ELSE acc END
  FROM (SELECT r.doc_id, r.rn, r."start", r."end", w.acc,
          len(list_filter(w.acc, lambda a: a.s < r."end" AND r."start" < a.e)) = 0 AS free
        FROM w JOIN r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1))
SELECT r.doc_id, r."start"::INT AS "start", r."end"::INT AS "end", CASE label_idx WHEN 1 THEN 'ORG_NER'
  WHEN 2 THEN 'CODENAME_NER' WHEN 3 THEN 'LOCATION_NER' WHEN 4 THEN 'EMPID_NER' ELSE 'PERSON_NER' END AS kind, r.raw,
  round(r.prob, 4)::FLOAT::DOUBLE AS confidence
FROM w JOIN r USING (doc_id, rn) WHERE w.kept"""

_ANSWER_SPANS = f"""
answers AS ({ANSWERS}),
items AS (SELECT msg_id, text, generate_subscripts(objects, 1) AS k, unnest(objects) AS o
  FROM (SELECT *, regexp_extract_all(model_output, '\\{{"start":\\d+,"end":\\d+,"kind":"[A-Za-z]+"\\}}') AS objects FROM answers)),
parsed AS (SELECT msg_id, text, k, (o->>'start')::INT AS s, (o->>'end')::INT AS e, upper(o->>'kind') AS word FROM items),
late AS MATERIALIZED (SELECT msg_id, k, length(decode(encode(text)[1:s])) AS "start",
    length(decode(encode(text)[1:e])) AS "end",
    CASE word WHEN 'ORGANIZATION' THEN 'ORG_NER' WHEN 'PROJECT' THEN 'CODENAME_NER' WHEN 'LOCATION' THEN 'LOCATION_NER'
      ELSE 'PERSON_NER' END AS kind, decode(encode(text)[s + 1:e]) AS raw
  FROM parsed WHERE s < e AND e <= strlen(text))"""

ORACLES = {f"scan_{name}": (
    f"WITH {_TEXTS}, {O.hits_ctes('texts', 'doc_id', [pack])} SELECT doc_id, {_SPAN}, ord AS rule_no FROM hits")
    for name, pack in PACKS.items()}
ORACLES |= {
    "resolve_overlaps": f"WITH RECURSIVE {TURN_CTES} SELECT msg_id, {_SPAN} FROM spans",
    "detect_patterns": f"WITH RECURSIVE {_TEXTS}, {O.hits_ctes('texts', 'doc_id')}, {O.spans_ctes('doc_id')} "
                       f"SELECT doc_id, {_SPAN} FROM spans",
    "detect_structured": f"WITH RECURSIVE texts AS MATERIALIZED ({tabular_sql(K.DUCKDB)}), {structured_ctes('texts')} "
                         f"SELECT * FROM structured",
    "classify_columns": f"SELECT header, count(*) AS n, {_header_case('header')} AS kind FROM ({HEADERS}) GROUP BY header",
    "scan_table_columns": f"""
WITH t AS ({TABLE}), cells AS (
  SELECT order_id, 'full_name' AS column_name, 'NAME' AS kind, trim(full_name) AS raw FROM t UNION ALL
  SELECT order_id, 'ssn', 'SSN', trim(ssn) FROM t UNION ALL
  SELECT order_id, 'card_number', 'CREDITCARD', trim(card_number) FROM t UNION ALL
  SELECT order_id, 'email', 'EMAIL', trim(email) FROM t UNION ALL
  SELECT order_id, 'api_token', 'CREDENTIAL', trim(api_token) FROM t),
checked AS (SELECT *, {_DIGITS} FROM cells WHERE lower(raw) NOT IN {_EMPTY})
SELECT order_id, column_name, {_checked('kind', 'raw')} AS kind, raw, 0.9::FLOAT AS confidence FROM checked""",
    "detect_watchlist": f"WITH {_TEXTS}, {watch_ctes('texts')} SELECT * FROM watch",
    "tokenize_words": f"""
WITH {_TEXTS}, {word_ctes('texts')}
SELECT doc_id, count(*) AS words, {_hash_sum('"start"', '"end"', 'word')} FROM words GROUP BY doc_id""",
    "detect_terms": f"""
WITH {_TEXTS}, terms AS (SELECT DISTINCT lower(trim(term)) AS term FROM ({TERMS}) WHERE strlen(trim(term)) >= 2),
{watch_ctes('texts', r"order \d+|ref \d+|user\d+@example\d\.com|")}
SELECT * FROM watch WHERE lower(raw) IN (SELECT term FROM terms)""",
    "candidate_word_spans": f"""
WITH {_TEXTS}, {word_ctes('texts')}
SELECT a.doc_id, (b.i - a.i + 1)::INT AS width, count(*) AS windows, {_hash_sum('a.i - 1', 'a."start"', 'b."end"')}
FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 11 GROUP BY ALL""",
    "decode_stored_scores": f"WITH RECURSIVE c AS (SELECT *, {_PROB} FROM ({SCORES})), {_DECODED}",
    "decode_scored_spans": f"WITH RECURSIVE {_TEXTS}, {word_ctes('texts')}, {window_ctes()}, {_DECODED}",
    "detect_windows": f"WITH RECURSIVE {_TEXTS}, {word_ctes('texts')}, {window_ctes()}, {_DECODED}",
    "ingest_model_spans": f'WITH {_ANSWER_SPANS} SELECT msg_id, "start"::INT AS "start", "end"::INT AS "end", kind, raw, '
                          f"0.7::FLOAT AS confidence FROM late",
    "merge_spans": f"""
WITH RECURSIVE {TURN_CTES},
second AS (SELECT msg_id, k, (turn * 7 + k * 11)::INT AS s, (turn * 7 + k * 11 + 8 + k * 3)::INT AS e
  FROM turns, range(0, 6) t(k)),
free AS MATERIALIZED (SELECT msg_id, k, s, e, row_number() OVER (PARTITION BY msg_id ORDER BY k) AS rn FROM second x
  WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.msg_id = x.msg_id AND p."start" < x.e AND x.s < p."end")),
w AS (SELECT msg_id, k, s, e, rn, true AS kept, e AS cur FROM free WHERE rn = 1
  UNION ALL SELECT f.msg_id, f.k, f.s, f.e, f.rn, f.s >= w.cur, CASE WHEN f.s >= w.cur THEN f.e ELSE w.cur END
  FROM w JOIN free f ON f.msg_id = w.msg_id AND f.rn = w.rn + 1)
SELECT msg_id, {_SPAN} FROM spans
UNION ALL SELECT msg_id, s, e, 'ORG_NER', concat('w', k), 0.6::FLOAT FROM w WHERE kept""",
    "filter_packs": f"WITH RECURSIVE {TURN_CTES} SELECT msg_id, {_SPAN} FROM spans "
                    f"WHERE {O.pack()} NOT IN ('payment', 'network')",
    "annotate_spans": f"""
WITH RECURSIVE {TURN_CTES} SELECT msg_id, "start", kind, {O.label()} AS label, {O.pack()} AS pack,
  CASE WHEN {O.confidence()} >= 0.95::FLOAT THEN 'high' WHEN {O.confidence()} >= 0.85::FLOAT THEN 'medium' ELSE 'low' END AS tier,
  'regex' AS source FROM spans""",
    "detect_all": f"WITH RECURSIVE texts AS MATERIALIZED ({tabular_sql(K.DUCKDB)}), {merged_ctes('texts', 'identity')} SELECT * FROM merged",
    "with_detector": f"""
SELECT msg_id, CASE WHEN contains(text, 'wallet') THEN 'error' WHEN contains(text, 'jwt ') THEN 'not_loaded' ELSE 'ok' END AS status,
  CASE WHEN contains(text, 'wallet') THEN 'no wallets' WHEN contains(text, 'jwt ') THEN 'model file' END AS error,
  CASE WHEN NOT contains(text, 'wallet') AND NOT contains(text, 'jwt ') AND contains(text, 'Helios')
    THEN (strpos(text, 'Helios') - 1)::INT END AS "start",
  CASE WHEN NOT contains(text, 'wallet') AND NOT contains(text, 'jwt ') AND contains(text, 'Helios') THEN 'Helios' END AS raw
FROM ({K.turns_sql(K.DUCKDB)})""",
    "late_scan": f"""
WITH RECURSIVE {TURN_CTES}, {_ANSWER_SPANS}
SELECT msg_id, (row_number() OVER (PARTITION BY msg_id ORDER BY k) - 1)::INT AS seq_in_msg, kind, sha256(raw) AS raw_hash,
  '' AS alias, 'PARANOID' AS action, 'llm' AS source FROM late
WHERE msg_id NOT IN (SELECT msg_id FROM spans WHERE {O.critical()})""",
    "revalidate_spans": f"""
WITH RECURSIVE {TURN_CTES}, edited AS (SELECT msg_id, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN concat('+', text)
  ELSE left(text, length(text) - 20) END AS text FROM turns)
SELECT s.msg_id, s."start", s."end", s.kind, s.raw FROM spans s JOIN edited e USING (msg_id)
WHERE s."end" <= length(e.text) AND substr(e.text, s."start" + 1, s."end" - s."start") = s.raw""",
}
