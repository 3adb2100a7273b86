"""A small linear scorer of word windows: word shapes inside, cue words at the edges and before."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Shapes of words, tried in this order; the last takes what is left.
SHAPES = (("badge", "^EMP-[0-9]+$"), ("title", "^[A-Z][a-z]+$"), ("upper", "^[A-Z][A-Z]+$"), ("digit", "[0-9]"), ("lower", "^[a-z]+$"),
          ("other", ""))


@dataclass(frozen=True)
class Label:
    """What one label adds to a window's score, in quarters: a bias, each word by its shape, and cues in lower case."""

    bias: int
    inside: dict[str, int]
    before: dict[str, int] = field(default_factory=dict)
    first: dict[str, int] = field(default_factory=dict)
    last: dict[str, int] = field(default_factory=dict)

    def shape(self, name: str) -> int:
        """Shapes that a label does not name speak against it."""
        return self.inside.get(name, -30)


#: Person, organisation, code name, location, employee id, in the order of the span labels.
LABELS = (
    Label(-9, {"title": 5, "upper": -6}, before={"mr": 6, "mrs": 6, "dr": 6, "by": 6}),
    Label(-10, {"title": 4, "upper": 5, "digit": -8}, before={"at": 2, "of": 2}, last={w: 8 for w in ("labs", "inc", "corp", "ltd", "gmbh")}),
    Label(-9, {"title": 3, "upper": 3}, first={"project": 10, "operation": 10}),
    Label(-9, {"title": 4}, before={w: 6 for w in ("in", "at", "near", "from", "visit")}, last={"street": 4, "road": 4, "hill": 4}),
    Label(-9, {"badge": 15}),
)


class LinearSpanScorer:
    """Logits of windows of 1 to `max_width` words for every label.  Scores look at one word before a window."""

    context = 1
    #: Of the last shape and no cue, so it adds nothing before a window.
    separator = ""

    def __init__(self, labels: tuple[Label, ...] = LABELS, max_width: int = 12):
        self.labels, self.max_width = labels, max_width
        self.shapes = [(name, re.compile(pattern)) for name, pattern in SHAPES]
        self.inside = {name: [label.shape(name) for label in labels] for name, _ in SHAPES}
        self.row_of: dict[str, int] = {}
        #: What a known word adds to each label inside a window, before it, at its front and at its end.
        self.table = np.empty((1 << 16, 4, len(labels)))

    def _learn(self, word: str) -> int:
        shape, low = next(name for name, pattern in self.shapes if pattern.search(word)), word.lower()
        row = self.row_of[word] = len(self.row_of)
        self.table[row] = [self.inside[shape], *([getattr(label, name).get(low, 0) for label in self.labels] for name in ("before", "first", "last"))]
        return row

    def __call__(self, words: list[str], first: int, count: int) -> np.ndarray:
        """(count, max_width, labels) logits of the windows from words[first], words[first + 1] ...; `words` holds
        the word before them and all that the windows cover, windows over its end have no meaning."""
        if len(self.row_of) + len(words) > len(self.table):
            self.row_of.clear()
            if len(words) > len(self.table):
                self.table = np.empty((len(words), 4, len(self.labels)))
        rows = [*map(self.row_of.get, words)]
        if None in rows:
            rows = [self.row_of[w] if w in self.row_of else self._learn(w) for w in words]
        # By label and word, in quarters, which are exact however they are summed.
        inside, before, front, last = self.table[np.array(rows, np.int64)].transpose(1, 2, 0)
        none = np.zeros((len(self.labels), 1))
        upto = np.concatenate([none, np.cumsum(inside, axis=1)], axis=1)
        here = slice(first, first + count)
        lead = np.concatenate([none, before], axis=1)[:, here] + front[:, here] + np.array([[label.bias] for label in self.labels], float)
        ends = np.pad((upto[:, 1:] + last)[:, first:], ((0, 0), (0, self.max_width - 1)), "edge")[:, :count + self.max_width - 1]
        # What a window's first word decides, and what its last one does.
        logits = ((lead - upto[:, here]) / 4)[:, None] + sliding_window_view(ends / 4, self.max_width, axis=1).transpose(0, 2, 1)
        return logits.transpose(2, 1, 0)


def default_scorer() -> LinearSpanScorer:
    return LinearSpanScorer()
