"""Words, candidate windows and spans that come from outside models."""

from __future__ import annotations

import multiprocessing
import os
import threading
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from hushspan.functions import arrays as A
from hushspan.functions.words import word_lists
from hushspan.kinds import SPANS_TYPE
from hushspan.operators.scan import computed, explode_array

# ---- Fixed values ------------------------------------------------------------------------------
MAX_WIDTH = 12
SCORE_THRESHOLD = 0.5
MODEL_LABELS = ("PERSON_NER", "ORG_NER", "CODENAME_NER", "LOCATION_NER", "EMPID_NER")
OUTPUT_KINDS = {
    "PERSON": "PERSON_NER", "NAME": "PERSON_NER", "PERSON_NER": "PERSON_NER",
    "ORG": "ORG_NER", "ORGANIZATION": "ORG_NER", "ORG_NER": "ORG_NER",
    "CODENAME": "CODENAME_NER", "PROJECT": "CODENAME_NER", "CODENAME_NER": "CODENAME_NER",
    "LOCATION": "LOCATION_NER", "LOCATION_NER": "LOCATION_NER",
    "EMPID": "EMPID_NER", "EMPLOYEE": "EMPID_NER", "EMPID_NER": "EMPID_NER",
}
OUTPUT_CONFIDENCE = 0.7
# ---- end of the fixed values -------------------------------------------------------------------

WORD_TYPE = "struct<start:int,end:int,word:string>"
#: Words whose windows are handed on at once.
WINDOW_WORDS = 1 << 13


def tokenize_words(df: DataFrame, text: str = "text", out: str = "words") -> DataFrame:
    """Add the words of a text with their offsets.  One narrow pass; only the text goes to the Python worker."""
    return df.withColumn(out, F.arrow_udf(lambda texts: word_lists(texts), f"array<{WORD_TYPE}>")(F.col(text)))


def explode_words(df: DataFrame, words: str = "words") -> DataFrame:
    """One row per word, with its number in the text."""
    keep = [c for c in df.columns if c not in (words, "text")]
    rows = df.select(*keep, F.expr(f"posexplode_outer({words}) as (word_no, w)"))
    return rows.filter(F.col("word_no").isNotNull()).select(*keep, "word_no", "w.start", "w.end", "w.word")


def candidate_word_spans(df: DataFrame, words: str = "words", max_width: int = MAX_WIDTH,
                         each: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, each_type: str = "") -> DataFrame:
    """Every window of 1..max_width words.  Each word gives at most max_width rows, all made from
    its own document's row, so nothing is joined or shuffled.

    `each` sums up the windows of a batch where they were made, before they leave the worker; it gives rows of
    `each_type` and sees the columns of `df` as dictionary arrays, whose indices tell the rows apart.
    """
    keep = [c for c in df.columns if c not in (words, "text")]
    found = ("word_start", "width", "start", "end")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = (batch.column(len(keep) + n).flatten().to_numpy() for n in (0, 1))
            size = pc.fill_null(pc.list_value_length(batch.column(len(keep))), 0).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), size)
            number = np.arange(len(starts)) - np.repeat(np.cumsum(size) - size, size)
            left = np.repeat(size, size) - number
            for at in range(0, len(starts), WINDOW_WORDS):
                count = np.minimum(left[at:at + WINDOW_WORDS], max_width)
                first = np.repeat(np.arange(at, at + len(count)), count)
                more = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
                of = pa.array(row[first])
                places = [number[first], more + 1, starts[first], ends[first + more]]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.DictionaryArray.from_arrays(of, batch.column(n)) for n in range(len(keep))), *(pa.array(p.astype(np.int32, copy=False)) for p in places)],
                    [*keep, *found])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c.dictionary.take(c.indices) if n < len(keep) else c for n, c in enumerate(batch.columns)], [*keep, *found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(each or whole, windows(batches))
    fields = [df.schema[c] for c in keep] + [StructField(c, IntegerType()) for c in found]
    return df.select(*keep, F.col(words)["start"].alias("__starts"), F.col(words)["end"].alias("__ends")).mapInArrow(
        run, each_type if each else StructType(fields))


def decode_scored_spans(scores: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Scored windows (doc, word_start, width, label_idx, logit, start, end, raw) to span lists.

    Rows at or below the threshold leave before the shuffle.  The greedy choice then runs over the
    candidates of one document, best score first; ties keep the order of the candidates.
    """
    # Single precision, like the scores themselves, so that saturated scores tie the same way.
    prob = F.expr("cast(1 / (1 + exp(-cast(logit as double))) as float)")
    kept = (scores.withColumn("prob", prob)
            .filter(F.col("prob") > SCORE_THRESHOLD).filter(F.col("start") < F.col("end")))
    candidate = F.struct((-F.col("prob")).alias("neg"), "word_start", "width", "label_idx",
                         F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "raw")
    lists = kept.groupBy(doc).agg(F.sort_array(F.collect_list(candidate)).alias("__c"))
    chosen = F.arrow_udf(lambda found: _first_come(found), SPANS_TYPE)
    return lists.select(doc, F.sort_array(chosen("__c")).alias("spans"))


def _first_come(found: pa.Array) -> pa.Array:
    """Of lists of candidates, best first, those that overlap none taken before.

    What is taken lies apart, so the one that starts last before a candidate's end tells: a candidate
    costs a search in the places taken, not a look at each.
    """
    rows = found.flatten()
    starts, ends = (rows.field(c).to_pylist() for c in ("start", "end"))
    size = pc.fill_null(pc.list_value_length(found), 0).to_pylist()
    taken, counts, at = [], [0], 0
    for n in size:
        low, high = [], []
        for i in range(at, at + n):
            place = bisect_left(low, ends[i])
            if place == 0 or high[place - 1] <= starts[i]:
                low.insert(place, starts[i])
                high.insert(place, ends[i])
                taken.append(i)
        at += n
        counts.append(len(taken))
    rows = rows.take(pa.array(taken, pa.int64()))
    kinds = pc.fill_null(pa.array(MODEL_LABELS).take(pc.index_in(rows.field("label_idx").cast(pa.int64()), pa.array(range(len(MODEL_LABELS))))), "PERSON_NER")
    columns = [rows.field("start"), rows.field("end"), kinds, rows.field("raw"), pa.array([""] * len(taken), pa.string()),
               pc.negate(rows.field("neg"))]
    spans = pa.StructArray.from_arrays(columns, ["start", "end", "kind", "raw", "alias", "confidence"])
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)


# A JSON text, an object of plain values, and one whose values may be such objects; nothing backtracks.
_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_FLAT = rf'\{{[^{{}}"]*+(?:{_TEXT}[^{{}}"]*+)*+\}}'
_OBJECT = rf'\{{[^{{}}"]*+(?:(?:{_TEXT}|{_FLAT})[^{{}}"]*+)*+\}}'


def _salvaged(tail: str) -> str:
    """An array of the complete objects that the text starts with, or NULL if there are none."""
    leading = f"regexp_extract({tail}, {A.lit(rf'(?s)^\[\s*+(?:{_OBJECT}\s*+,?+\s*+)*+')}, 0)"
    objects = f"regexp_extract_all({leading}, {A.lit(f'(?s){_OBJECT}')}, 0)"
    return A.let(objects, lambda o: f"if(size({o}) > 0, concat('[', array_join({o}, ','), ']'), NULL)")


def model_output_sql(text: str, output: str) -> str:
    """Spans named in a model's JSON answer, as array<SPAN_TYPE>.

    The answer counts UTF-8 bytes.  Prose around the array is ignored, and an array that was cut off
    or is broken still gives its complete leading objects.
    """
    schema = "array<struct<start:bigint,end:bigint,kind:string>>"
    x, s = A.name("x"), A.name("s")

    def parsed(value: str) -> str:
        items = f"from_json({value}, '{schema}', map('allowSingleQuotes', 'false'))"
        return A.let(items, lambda p: (
            f"if(forall({p}, {x} -> {x}.start >= 0 AND {x}.end >= 0 AND {x}.kind IS NOT NULL), {p}, NULL)"))
    kinds: dict[str, list[str]] = {}
    for word, kind in OUTPUT_KINDS.items():
        kinds.setdefault(kind, []).append(word)
    kind = "CASE " + " ".join(
        f"WHEN upper({s}.kind) IN ({', '.join(repr(w) for w in ws)}) THEN '{k}'"
        for k, ws in kinds.items()) + " ELSE 'PERSON_NER' END"
    data = f"encode({text}, 'UTF-8')"

    def piece(start: str, size: str) -> str:
        return f"decode(substr({data}, cast({start} as int), cast({size} as int)), 'UTF-8')"
    begin = f"length({piece('1', f'{s}.start')})"
    raw = piece(f"{s}.start + 1", f"{s}.end - {s}.start")
    span = A.let(raw, lambda r: (
        f"named_struct('start', {begin}, 'end', {begin} + length({r}), 'kind', {kind}, 'raw', {r},"
        f" 'alias', '', 'confidence', cast({OUTPUT_CONFIDENCE} as float))"))

    def from_tail(tail: str) -> str:
        closed = f"regexp_extract({tail}, {A.lit(r'(?s)^.*\]')}, 0)"
        items = (f"coalesce(if(contains({tail}, ']'), {parsed(closed)}, NULL), {parsed(_salvaged(tail))})")
        bounded = (f"filter({items}, {s} -> {s}.start < {s}.end AND {s}.end <= octet_length({text}))")
        return f"transform({bounded}, {s} -> {span})"
    found = A.let(f"substr({output}, instr({output}, '['))", from_tail)
    return (f"if(contains({output}, '['), coalesce({found}, cast(array() as {SPANS_TYPE})), "
            f"cast(array() as {SPANS_TYPE}))")


def ingest_model_spans(df: DataFrame, text: str = "text", output: str = "model_output",
                       out: str = "spans") -> DataFrame:
    return computed(df, out, f"coalesce({model_output_sql(text, output)}, cast(array() as {SPANS_TYPE}))")


Detector = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]


class NotLoaded(Exception):
    """Raised by a detector whose model is missing."""


def _serve(detector: Detector, calls, mine) -> None:
    """A child's loop: lists of texts in, found spans or the failure out; it ends with its parent."""
    mine.close()
    parent = multiprocessing.parent_process()
    threading.Thread(target=lambda: (parent.join(), os._exit(1)), daemon=True).start()
    while True:
        try:
            values = calls.recv()
        except EOFError:
            return
        try:
            found = [[(int(s), int(e), str(k), float(c)) for s, e, k, c in spans] for spans in detector(values)]
            if len(found) != len(values):
                raise ValueError(f"{len(found)} lists of spans for {len(values)} texts")
            calls.send(("ok", found))
        except NotLoaded as error:
            calls.send(("not_loaded", str(error)))
        except Exception as error:  # noqa: BLE001 - any detector failure degrades to no spans
            calls.send(("error", str(error)))


class _Child:
    """A detector in a process of its own, started when it is called and ended when a call is late."""

    def __init__(self, detector: Detector):
        self.detector, self.process, self.calls = detector, None, None

    def call(self, values: list[str], seconds: float) -> tuple:
        if self.process is None:
            forked = multiprocessing.get_context("fork")
            self.calls, theirs = forked.Pipe()
            self.process = forked.Process(target=_serve, args=(self.detector, theirs, self.calls), daemon=True)
            self.process.start()
            theirs.close()
        try:
            self.calls.send(values)
            if self.calls.poll(seconds):
                return self.calls.recv()
        except (EOFError, OSError):
            self.end()
            return "error", "the detector's process ended"
        self.end()
        return "timeout", None

    def end(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.calls.close()
            self.process = None


def with_detector(df: DataFrame, detector: Detector, doc: str = "doc_id", text: str = "text",
                  timeout_ms: int = 500, size: int = 32) -> DataFrame:
    """Run a user detector on lists of `size` texts in Arrow batches: a list of (start, end, kind, confidence) each.

    Gives doc, status (ok / timeout / not_loaded / error), error and spans.  A list that fails or takes
    over `timeout_ms` for each of its texts is tried again text by text, so a bad text costs the
    others nothing.  One that fails or is late alone gives no spans and never fails the job.  The
    detector runs in a child process of the task; a late call is ended with the process and the next
    call starts another, so every text is tried.  What a detector loads at its first call is loaded
    again after that, within the time of that call.  A null text is read as an empty one.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child = _Child(detector)

        def some(values: list[str]) -> list[tuple]:
            status, found = child.call(values, timeout_ms / 1000 * len(values))
            if status == "ok":
                return [("ok", None, [
                    {"start": s, "end": e, "kind": k, "raw": value[s:e], "alias": "", "confidence": c}
                    for s, e, k, c in spans]) for value, spans in zip(values, found, strict=True)]
            if len(values) > 1:
                return [row for value in values for row in some([value])]
            return [(status, found, [])]

        try:
            for batch in batches:
                values = ["" if value is None else value for value in batch[text]]
                rows = [row for at in range(0, len(values), size) for row in some(values[at:at + size])]
                yield pd.DataFrame({
                    doc: batch[doc], "status": [r[0] for r in rows], "error": [r[1] for r in rows],
                    "spans": [r[2] for r in rows]})
        finally:
            child.end()
    doc_type = df.schema[doc].dataType.simpleString()
    return df.select(doc, text).mapInPandas(
        run, f"{doc} {doc_type}, status string, error string, spans {SPANS_TYPE}")


def revalidate_spans(spans: DataFrame, documents: DataFrame, doc: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Keep the stored spans whose raw value still stands at their place in the current text.

    The spans are put in one list per document first, so a text with many spans crosses the join once.
    """
    cols = [c for c in spans.columns if c != doc]
    lists = spans.groupBy(doc).agg(F.collect_list(F.struct(*cols)).alias("__spans"))
    s = A.name("s")
    good = (f"filter(__spans, {s} -> {s}.start >= 0 AND {s}.start < {s}.end AND {s}.end <= length({text})"
            f" AND substr({text}, {s}.start + 1, {s}.end - {s}.start) = {s}.raw)")
    joined = lists.join(documents.select(doc, text), doc)
    return explode_array(joined.select(doc, F.expr(good).alias("__good")), "__good")
