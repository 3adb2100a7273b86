"""Rows of one key and micro-batch in order, however many there are."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import pandas as pd

#: Frames of a key that a worker holds; more are sorted, cut into runs and put into state until they are merged.
FRAMES = 4
#: Rows of a part of a run; the merge holds one part of each run.
PART_ROWS = 512
#: Rows of the frames that are given out.
OUT_ROWS = 10_000


def in_order(rows: Iterator[pd.DataFrame], by: list[str], held, frames: int = FRAMES, part_rows: int = PART_ROWS,
             out_rows: int = OUT_ROWS) -> Iterator[pd.DataFrame]:
    """The frames of a key, sorted by `by` as one.

    `held` is a map state (int -> binary) that is empty before and after.  A key with few rows never
    touches it; a hot one costs a worker `frames` frames and one part of each sorted run.
    """
    kept: list[pd.DataFrame] = []
    runs: list[range] = []
    used = 0
    for frame in rows:
        if len(kept) == frames:
            run = pd.concat(kept).sort_values(by, kind="stable")
            kept = []
            begin = used
            for at in range(0, len(run), part_rows):
                held.updateValue((used,), (pickle.dumps(run.iloc[at:at + part_rows]),))
                used += 1
            runs.append(range(begin, used))
        kept.append(frame)
    if not kept:
        return
    last = pd.concat(kept).sort_values(by, kind="stable")
    if not runs:
        yield last
        return
    columns = list(last.columns)
    places = [columns.index(b) for b in by]

    def read(run: range) -> Iterator[tuple]:
        for number in run:
            part = pickle.loads(held.getValue((number,))[0])
            held.removeKey((number,))
            yield from part.itertuples(index=False, name=None)

    merged = heapq.merge(*map(read, runs), last.itertuples(index=False, name=None), key=lambda row: tuple(row[p] for p in places))
    while some := [row for _, row in zip(range(out_rows), merged)]:
        yield pd.DataFrame(some, columns=columns)
