"""Watchlists of any length: an index of terms by their words, walked along each text.

A term is a chain of units, runs of word characters and single other characters.  The index is a tree
of such chains; a text is cut into units once, and at each unit the tree is followed as far as the text
goes along with it.  The work therefore does not grow with the number of terms, and the plan holds none
of them.  Tables too long for an index are joined with the runs of units that a filter lets through.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.functions.rules import CLOSE, OPEN
from hushspan.functions.textscan import WORD
from hushspan.kinds import SPANS_TYPE
from hushspan.operators.watchlist import MAX_BYTES, MIN_BYTES
from hushspan.sources.interim import materialize

#: Bytes of terms in one index, some 100 MB in a worker at most; a longer list is joined.
INDEX_BYTES = 4 << 20
_WORD = WORD
_UNIT = regex.compile(_WORD.pattern + "+|.", regex.DOTALL)
_APART = frozenset((OPEN, CLOSE, "İ", "ı"))


@lru_cache(maxsize=1)
def folds() -> dict[int, int]:
    """Characters that compare as another one without regard to case, each as one character.

    The markers and the dotted and dotless i, which the rules keep apart from "i", become letters or
    marks that stand for them in every detector.
    """
    table = {}
    for code in range(sys.maxunicode + 1):
        up = chr(code).upper()
        low = (up if len(up) == 1 else chr(code)).lower()
        if len(low) == 1 and ord(low) != code:
            table[code] = ord(low)
    return table | {ord(OPEN): 0xF8FF, ord(CLOSE): 0xF8FF, ord("İ"): ord("ŀ"), ord("ı"): ord("ŀ")}


class TermIndex:
    """Terms as a tree of units: an edge for each node and unit, and the first term that ends at a node."""

    def __init__(self, terms: list[str]):
        self.edges: dict[tuple[int, str], int] = {}
        self.best: dict[int, tuple[int, str]] = {}
        for term in terms:
            node = 0
            for unit in _UNIT.findall(_folded(term)):
                node = self.edges.setdefault((node, unit), len(self.edges) + 1)
            rank = (-len(term.encode()), term)
            self.best[node] = min(self.best.get(node, rank), rank)
        self.firsts = {unit: node for (above, unit), node in self.edges.items() if not above}

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, minus the term's bytes) of the first choice at every place where a term stands as whole words."""
        units = _UNIT.findall(text.lower() if text.isascii() else text.translate(folds()))
        best = self.best
        # Most units start no term, so what a unit is and where it stands is asked for few.
        firsts = [(i, self.firsts[unit]) for i, unit in enumerate(units) if unit in self.firsts]
        offsets = [0, *accumulate(map(len, units))] if firsts else [0]

        def word(i: int) -> bool:
            return i < len(units) and _WORD.match(units[i]) is not None
        for i, node in firsts:
            # A term that starts with another character than a word's starts right behind a word.
            if not (word(i) or (i and word(i - 1))):
                continue
            found, j = None, i
            while node is not None:
                j += 1
                rank = best.get(node)
                if rank and (found is None or rank < found[0]) and (word(j - 1) or word(j)):
                    found = (rank, j)
                node = self.edges.get((node, units[j])) if j < len(units) else None
            if found:
                yield offsets[i], offsets[found[1]], found[0][0]


def leftmost(matches) -> list[tuple[int, int]]:
    """From the left, the longest term of those that start first; what overlaps it goes."""
    out, cursor = [], 0
    for start, _, end in sorted((s, b, e) for s, e, b in matches):
        if start >= cursor:
            out.append((start, end))
            cursor = end
    return out


_INDEXES: dict[str, TermIndex] = {}


def _index(name: str, terms) -> TermIndex:
    """The index of a broadcast list, made once in a worker; the last two stay."""
    if name not in _INDEXES:
        while len(_INDEXES) > 1:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[name] = TermIndex(terms.value)
    return _INDEXES[name]


def clean_term_table(terms: DataFrame, term: str = "term") -> DataFrame:
    """The valid terms of a table, trimmed, each once; nulls and terms of invalid length are left out."""
    value = F.regexp_replace(F.col(term), r"(?U)^\s+|\s+$", "")
    size = F.octet_length(value)
    return terms.select(value.alias("term")).where((size >= MIN_BYTES) & (size <= MAX_BYTES)).distinct()


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("raw", pa.string()),
                            ("alias", pa.string()), ("confidence", pa.float32())]))
#: Bits of the filter that tells most texts' word runs from terms, at most; 32 MB.
FILTER_BITS = 1 << 28


def detect_terms(df: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", out: str = "spans",
                 index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Add the spans of a table of terms, as `detect_watchlist` adds those of a short list.

    Whole words without regard to case; from the left, the longest term in bytes first.  Terms of about
    `index_bytes` are sent to the workers as an index, and this is a single narrow pass.  A longer table
    is never sent: a filter of bounded size picks the runs of words that may be terms in one pass over the
    texts, those runs are joined with the table, and what was found comes back to its row.  A null text
    has no spans; no terms give none.
    """
    spark = df.sparkSession
    terms = materialize(clean_term_table(terms, term))
    total = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]
    columns = [c for c in df.columns if c != out]
    if total <= index_bytes:
        sent = spark.sparkContext.broadcast([r.term for r in terms.collect()])
        return _pass(df.select(*columns), sent, uuid.uuid4().hex, text, out)
    return _joined(df.select(*columns), terms, text, out)


def _folded(term: str) -> str:
    """A term as texts are compared with it.  Only texts are cleaned, so one with such a character never matches."""
    if term.isascii():
        return term.lower()
    return "".join(c if c in _APART else chr(folds().get(ord(c), ord(c))) for c in term)


def _bits(value: str, bits: int) -> tuple[int, int]:
    """The two places of a text in the filter."""
    both = xxhash.xxh64_intdigest(value.encode(), 11)
    return both & (bits - 1), (both >> 32) & (bits - 1)


def _described(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(0).to_pylist()
            folded = [_folded(t) for t in terms]
            units = [_UNIT.findall(f) for f in folded]
            # The first unit has places of its own, so that most words of a text are passed over at once.
            marks = [[*_bits(f, bits), *_bits("\0" + u[0], bits)] for f, u in zip(folded, units)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(folded, pa.string()), pa.array([len(u) for u in units], pa.int32()), pa.array(marks, pa.list_(pa.int64()))],
                ["term", "folded", "units", "marks"])
    return run


class _Firsts(dict):
    """Whether a unit starts a term, and as a word; asked of the filter once a unit."""

    def __init__(self, there: Callable[[str], bool]):
        self.there = there

    def __missing__(self, unit: str) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[unit] = (1 + bool(_WORD.match(unit))) if self.there("\0" + unit) else 0
        return found


def _candidates(sent, sizes: list[int], bits: int):
    """(row, start, end, folded) of the runs of units that the filter lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(sent.value, np.uint8)

        def there(value: str) -> bool:
            return all(words[p >> 3] >> (p & 7) & 1 for p in _bits(value, bits))
        known = _Firsts(there)
        for batch in batches:
            found: tuple[list, list, list, list] = ([], [], [], [])
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = value or ""
                value = value.lower() if value.isascii() else value.translate(folds())
                units = _UNIT.findall(value)
                firsts = [i for i, unit in enumerate(units) if known[unit]]
                # Most units start no term, so what a unit is and where it stands is asked for few.
                offsets = [0, *accumulate(map(len, units))] if firsts else [0]
                for i in firsts:
                    if known[units[i]] == 1 and not (i and _WORD.match(units[i - 1])):
                        continue
                    for size in sizes:
                        j = i + size
                        if j > len(units):
                            break
                        if (_WORD.match(units[j - 1]) or (j < len(units) and _WORD.match(units[j]))) and there(run := value[offsets[i]:offsets[j]]):
                            for column, item in zip(found, (row, offsets[i], offsets[j], run)):
                                column.append(item)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["__row", "start", "end", "folded"])
    return run


def _joined(df: DataFrame, terms: DataFrame, text: str, out: str) -> DataFrame:
    """The spans of a table of terms of any length, by a join with what the texts may hold."""
    spark = df.sparkSession
    count = terms.count()
    bits = min(FILTER_BITS, 1 << max(16, (16 * count).bit_length()))
    described = materialize(terms.mapInArrow(_described(bits), "term string, folded string, units int, marks array<long>"))
    sizes = sorted(r.units for r in described.select("units").distinct().collect())
    # At most a long for every 64 bits of the filter, whatever the number of terms.
    marks = described.select(F.explode("marks").alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    words = np.zeros(bits // 64, "<i8")
    words[marks.column("word").to_numpy()] = marks.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(words.tobytes())
    df = materialize(df.withColumn("__row", F.monotonically_increasing_id()))
    runs = df.select("__row", text).mapInArrow(_candidates(sent, sizes, bits), "__row long, start int, end int, folded string")
    best = described.groupBy("folded").agg(F.min(F.struct((-F.octet_length("term")).alias("rank"), "term")).alias("best"))
    place = F.struct("start", F.col("best.rank").alias("rank"), F.col("best.term").alias("term"), "end")
    found = runs.join(best, "folded").groupBy("__row").agg(F.collect_list(place).alias("__places"))
    rows = df.join(found, "__row", "left")
    spans = F.arrow_udf(lambda texts, places: _spans(texts, places), SPANS_TYPE)(F.col(text), F.col("__places"))
    return rows.select(*df.columns[:-1], spans.alias(out))


def _spans(texts: pa.Array, places: pa.Array) -> pa.Array:
    rows = []
    for value, found in zip(texts.to_pylist(), places.to_pylist()):
        kept, cursor = [], 0
        for place in sorted((p["start"], p["rank"], p["term"], p["end"]) for p in found or []):
            if place[0] >= cursor:
                cursor = place[3]
                kept.append(_span(value, place[0], cursor))
        rows.append(kept)
    return pa.array(rows, _SPAN)


def _span(text: str, start: int, end: int) -> dict:
    return {"start": start, "end": end, "kind": "CUSTOM", "raw": text[start:end], "alias": "", "confidence": 1.0}


def _pass(df: DataFrame, sent, name: str, text: str, out: str) -> DataFrame:
    """One narrow pass with an index of all terms."""
    def run(texts: pa.Array) -> pa.Array:
        index = _index(name, sent)
        values = [value or "" for value in texts.to_pylist()]
        return pa.array([[_span(v, s, e) for s, e in leftmost(index.matches(v))] for v in values], _SPAN)
    return df.withColumn(out, F.arrow_udf(run, SPANS_TYPE)(F.col(text)))
