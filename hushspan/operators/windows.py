"""Scored word windows: a span scorer run over whole texts in Arrow batches, and the choice among its windows.

A scorer is loaded once in a Python worker and sees the words of a text in blocks with the context it
asks for, so a very long text needs no more memory than a block, and the scores are those of the whole.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.functions.words import places, together
from hushspan.kinds import SPANS_TYPE
from hushspan.operators.candidates import MAX_WIDTH, MODEL_LABELS, SCORE_THRESHOLD

#: Words whose windows are scored at once.
BLOCK = 1024
#: No window whose logit is less is over the threshold.
_LOGIT = math.log(SCORE_THRESHOLD / (1 - SCORE_THRESHOLD)) - 1e-3


class Scorer(Protocol):
    """Scores windows of words.  `context` words before a window may count, and the window itself.

    A scorer may name as `separator` a word that counts before a window as none does, and never is a word of a text;
    texts are then scored many at once, with it between them.
    """

    context: int

    def __call__(self, words: list[str], first: int, count: int) -> np.ndarray:
        """(count, max width, labels) logits of the windows that start at words[first], words[first + 1] ..."""


_LOADED: dict[bytes, Scorer] = {}


def loaded(load: bytes) -> Scorer:
    """The scorer that a pickled function gives, called once in a worker."""
    if load not in _LOADED:
        _LOADED[load] = pickle.loads(load)()
    return _LOADED[load]


def probabilities(logits: np.ndarray) -> np.ndarray:
    """In single precision, like model scores, so that saturated ones tie the same way everywhere."""
    with np.errstate(over="ignore"):
        return (1 / (1 + np.exp(-logits.astype(float)))).astype(np.float32)


def scored(scorer: Scorer, words: list[str], max_width: int, block: int = BLOCK, last: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(word_start, width, label, logit, probability) of the windows over the threshold, block by block.

    No window reaches over the place that `last` gives for its first word, the end of the words by default.
    """
    if last is None:
        last = np.full(len(words), len(words))
    for at in range(0, len(words), block):
        low = max(0, at - scorer.context)
        count = min(block, len(words) - at)
        logits = np.asarray(scorer(words[low:at + count + max_width - 1], at - low, count), float)[:, :max_width]
        # Probabilities rise with logits and are only worked out where they may be over the threshold.
        start, width, label = np.unravel_index(np.flatnonzero(~(logits < _LOGIT)), logits.shape)
        inside = start + width + at < last[start + at]
        start, width, label = start[inside], width[inside], label[inside]
        logit = logits[start, width, label]
        chance = probabilities(logit)
        over = chance > SCORE_THRESHOLD
        yield start[over] + at, width[over] + 1, label[over], logit[over], chance[over]


def chosen(start: np.ndarray, width: np.ndarray, label: np.ndarray, chance: np.ndarray, words: int) -> np.ndarray:
    """Places of the windows that are taken, best first, none over a word that is taken already; by start.

    Ties keep the order of word, width and label.  A window looks at its own words only, so the work
    grows with the windows and not with their square.
    """
    taken, kept = bytearray(words), []
    for i in np.lexsort((label, width, start, -chance)).tolist():
        low, high = int(start[i]), int(start[i] + width[i])
        if taken.find(1, low, high) < 0:
            taken[low:high] = b"\1" * (high - low)
            kept.append(i)
    return np.array(sorted(kept, key=start.__getitem__), np.int64)


def _given(df: DataFrame, doc: str, text: str) -> DataFrame:
    return df.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _windows(scorer: Scorer, batch: pa.RecordBatch, max_width: int) -> Iterator[tuple]:
    """(row, place among the words of these texts, word_start, width, label, logit, probability, start, end, texts of these rows, first of these rows) of the
    windows over the threshold, for some texts at once."""
    gap = scorer.context
    separator = getattr(scorer, "separator", None)
    row = 0
    for some in together(batch.column(1).to_pylist()):
        for texts in [some] if separator is not None else ([text] for text in some):
            counts, starts, ends, words = places(texts)
            upto = np.cumsum(counts)
            words = words.dictionary_encode()
            words = np.array(words.dictionary.to_pylist(), object)[words.indices.to_numpy()].tolist()
            between, joined = [separator] * gap, []
            for end, count in zip(upto.tolist(), counts.tolist()):
                joined += words[end - count:end]
                joined += between
            # Places of the joined words: of each text's first and last, and of each word's text.
            first = upto - counts + gap * np.arange(len(texts))
            of = np.repeat(np.arange(len(texts)), counts + gap)
            last = (first + counts)[of]
            if separator is None:
                joined, last = words, None
            for at, width, label, logit, chance in scored(scorer, joined, max_width, BLOCK, last):
                text = of[at]
                word = at - gap * text
                yield text + row, at, at - first[text], width, label, logit, chance, starts[word], ends[word + width - 1], texts, row
            row += len(texts)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("raw", pa.string()),
                            ("alias", pa.string()), ("confidence", pa.float32())]))


def score_windows(df: DataFrame, load: Callable[[], Scorer], doc: str = "doc_id", text: str = "text",
                  max_width: int = MAX_WIDTH) -> DataFrame:
    """Long table (doc, word_start, width, label_idx, logit, start, end, raw) of the windows of 1..max_width words
    whose probability is over the threshold.

    `load` must be known by name on the executors (a function of a module, or a partial of one) and is
    called once in a worker.  Windows at or below the threshold never leave it.  A null text has none.
    """
    made = pickle.dumps(load)
    kind = df.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = loaded(made)
        for batch in batches:
            for rows, _, start, width, label, logit, _, low, high, texts, begin in _windows(scorer, batch, max_width):
                raw = [texts[row][a:b] for row, a, b in zip((rows - begin).tolist(), low.tolist(), high.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(start, pa.int32()), pa.array(width, pa.int32()), pa.array(label, pa.int32()),
                     pa.array(logit, pa.float64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(raw, pa.string())],
                    ["doc", "word_start", "width", "label_idx", "logit", "start", "end", "raw"])

    return _given(df, doc, text).mapInArrow(
        run, f"doc {kind}, word_start int, width int, label_idx int, logit double, start int, end int, raw string"
    ).withColumnRenamed("doc", doc)


def detect_windows(df: DataFrame, load: Callable[[], Scorer], doc: str = "doc_id", text: str = "text",
                   max_width: int = MAX_WIDTH) -> DataFrame:
    """(doc, spans): the windows that a scorer finds and the greedy choice takes, for every row.

    One narrow pass: windows are scored and chosen where the text is, nothing is shuffled.  A text
    without a window, or a null one, has an empty list.  `load` as in `score_windows`.
    """
    made = pickle.dumps(load)
    kind = df.schema[doc].dataType.simpleString()

    def taken(parts: list[tuple]) -> tuple:
        """Row, start, end, label, raw and probability of what is taken of some texts' windows; no two texts share a place."""
        rows, at, _, width, label, _, chance, low, high = (np.concatenate(p) for p in list(zip(*parts))[:9])
        texts, begin = parts[0][9:]
        kept = chosen(at, width, label, chance, int((at + width).max(initial=0)))
        rows, low, high = rows[kept], low[kept], high[kept]
        raw = [texts[row][a:b] for row, a, b in zip((rows - begin).tolist(), low.tolist(), high.tolist())]
        return rows, low, high, label[kept], pa.array(raw, pa.string()), chance[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = loaded(made)
        for batch in batches:
            found = [taken(list(parts)) for _, parts in groupby(_windows(scorer, batch, max_width), key=itemgetter(10))]
            rows, low, high, label, raw, chance = zip(*found) if found else ([np.empty(0, np.int64)],) * 4 + ([pa.array([], pa.string())], [np.empty(0, np.float32)])
            counts = np.bincount(np.concatenate(rows), minlength=batch.num_rows)
            size = int(counts.sum())
            columns = [pa.array(np.concatenate(low), pa.int32()), pa.array(np.concatenate(high), pa.int32()),
                       pa.array(MODEL_LABELS, pa.string()).take(pa.array(np.concatenate(label))), pa.concat_arrays(raw),
                       pa.array([""] * size, pa.string()), pa.array(np.concatenate(chance), pa.float32())]
            spans = pa.StructArray.from_arrays(columns, fields=list(_SPAN.value_type))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, spans)], ["doc", "spans"])

    return _given(df, doc, text).mapInArrow(run, f"doc {kind}, spans {SPANS_TYPE}").withColumnRenamed("doc", doc)
