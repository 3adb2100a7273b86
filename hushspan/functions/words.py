"""Where the words of a text are, and words as Arrow lists."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hushspan.functions.textscan import SPACE, WORD

_IN_WORD, _BLANK = 1, 2
#: Characters of texts that are looked at as one, so that short texts cost little each.
TOGETHER = 1 << 18


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Part of a word, white space or neither, for every character."""
    chars = "".join(chr(c) if not 0xd800 <= c < 0xe000 else "." for c in range(sys.maxunicode + 1))
    table = np.zeros(len(chars), np.uint8)
    for value, pattern in ((_IN_WORD, WORD), (_BLANK, SPACE)):
        table[np.fromiter((m.start() for m in pattern.finditer(chars)), np.int64)] = value
    return table


@lru_cache(maxsize=1)
def _ascii() -> bytes:
    return _classes()[:256].tobytes()


def _kinds(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode().translate(_ascii()), np.uint8)
    return _classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def word_places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, which characters are part of a word) of the words of a text: `\\w+(?:[-_]\\w+)*|\\S`.

    A hyphen between two characters of words joins them; any other character that is no white space is
    a word by itself.
    """
    kind = _kinds(text)
    inside = kind == _IN_WORD
    joined = inside.copy()
    if "-" in text:
        hyphen = np.frombuffer(text.encode(), np.uint8) == ord("-") if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32) == ord("-")
        joined[1:-1] |= hyphen[1:-1] & inside[:-2] & inside[2:]
    alone = ~joined & (kind != _BLANK)
    edge = np.concatenate([[False], joined, [False]])
    starts = np.flatnonzero((joined & ~edge[:-2]) | alone)
    ends = np.flatnonzero((joined & ~edge[2:]) | alone) + 1
    return starts, ends, joined | alone


def together(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Lists of texts that are looked at as one, a null one as an empty one; a long text by itself."""
    some: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if some and size + len(text) > TOGETHER:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text) + 1
    if some:
        yield some


def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(words of each text, their starts, their ends, themselves) of some texts, found in all of them at once.

    The line end that is put between two texts is part of no word.
    """
    text = "\n".join(texts)
    low, high, kept = word_places(text)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(low, begin))
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) == len(text):
        size = high - low
    else:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        upto = np.concatenate([[0], np.cumsum(width)])
        size, kept = upto[high] - upto[low], np.repeat(kept, width)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[kept]))
    at = np.repeat(begin[:-1], counts)
    return counts, (low - at).astype(np.int32), (high - at).astype(np.int32), words


def word_lists(texts: pa.Array) -> pa.Array:
    """A list of (start, end, word) for every text; null for a null one."""
    # One empty list more, as there may be no texts.
    counts, starts, ends, words = zip(*map(places, [*together(texts.to_pylist()), []]))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    columns = [pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends)), pa.concat_arrays(words)]
    items = pa.StructArray.from_arrays(columns, ["start", "end", "word"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, mask=pc.is_null(texts))
