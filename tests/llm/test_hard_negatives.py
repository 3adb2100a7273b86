"""Hard negatives against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushspan.llm import hardnegatives
from tests.llm.helpers import clashing, rows

VECTORS = "vec_id long, embedding array<double>, label int"


def plain(given, positives=5, negatives=10, least=30, most=90, scale=256, anchor=lambda i: i % 100 == 0):
    """Every pair compared in Python's whole numbers."""
    good = [(i, tuple(math.floor(scale * x) for x in v), n) for i, v, n in given
            if i is not None and v is not None and n is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, v, label in sorted({r for r in good if anchor(r[0])}):
        scored = [(-sum(a * b for a, b in zip(v, w)), i, n) for i, w, n in good if i != own]
        same = sorted((s, i) for s, i, n in scored if n == label)[:positives]
        for s, i in same:
            other = sorted((t, j) for t, j, n in scored if n != label and least * -s <= 100 * -t <= most * -s)[:negatives]
            out += [(own, i, rank, j, -s, -t) for rank, (t, j) in enumerate(other, 1)]
    return sorted(out, key=repr)


def mined(spark, given, **options):
    return rows(hardnegatives.mine(spark.createDataFrame(given, VECTORS), F.col("vec_id") % 100 == 0, **options))


def vectors(count, width, labels, seed, spread=1.0):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(labels, width))
    named = random.integers(labels, size=count)
    found = (centres[named] + spread * random.normal(size=(count, width))) * random.lognormal(0, 0.7, (count, 1))
    return [(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(found / np.sqrt(width), named))]


@pytest.mark.parametrize("width,labels,spread", [(2, 3, 0.2), (8, 2, 1.0), (64, 10, 1.0), (5, 400, 0.5)])
def test_equal_to_all_pairs(spark, monkeypatch, width, labels, spread):
    monkeypatch.setattr(hardnegatives, "SHARD_ROWS", 300)
    monkeypatch.setattr(hardnegatives, "BLOCK_ANCHORS", 4)
    given = vectors(1200, width, labels, width, spread)
    assert mined(spark, given) == plain(given)
    assert mined(spark, given, positives=2, negatives=1, least=0, most=100) == plain(given, 2, 1, 0, 100)


def test_awkward_rows(spark):
    given = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (200, [-1.0, 0.0], 2), (300, [0.0, 0.0], 1),
             (400, [], 1), (500, None, 1), (600, [1.0, None], 1), (700, [1.0, float("nan")], 1),
             (800, [float("inf"), 1.0], 1), (900, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (1000, [3.0], 2),
             (1, [0.5, 1.0], 2), (1, [0.5, 1.0], 2), (2, [0.5, 1.0], 3), (3, [0.7, 1.5], 1), (4, [1.0, 2.0, 9.0], 2),
             (5, [0.5, 1.0], 2), (0, [2.0, 1.0], 2), (6, [1e-9, 0.0], 4), (7, [0.0, 1.0], 1)]
    wanted = plain(given)
    assert wanted and mined(spark, given) == wanted
    table = clashing(spark.createDataFrame(given, VECTORS).withColumnRenamed("label", "kind"))
    assert rows(hardnegatives.mine(table, F.col("vec_id") % 100 == 0, "kind")) == wanted
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(100, 1, 1, 2, 65536, 32768)]


def test_a_crowd_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(hardnegatives, "SHARD_ROWS", 500)
    given = [(i, [0.25, 0.5, -0.125], i % 2) for i in range(1500)] + [(i, [0.2, 0.4, 0.0], i % 3) for i in range(1500, 2000)]
    assert mined(spark, given) == plain(given)


def test_numbers_beyond_double_precision(spark):
    big = float(1 << 26) + 0.5
    given = [(0, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big * 0.5, 3.0], 2), (3, [big * 0.5, 2.0], 2), (4, [big * 0.9, 1.0], 3)]
    assert mined(spark, given, scale=16) == plain(given, scale=16)


def test_feasible_ranges_lose_nothing():
    random = np.random.default_rng(3)
    for width in (1, 2, 3, 16):
        found = random.normal(size=(400, width))
        index = hardnegatives.Index(found, np.arange(400))
        for anchor in random.normal(size=(20, width)):
            scores = found @ anchor
            for least in (0.1, 0.5, 1.0, float(np.sort(scores)[-3])):
                got = {int(r) for part, _ in index.reaching(anchor, lambda: least) for r in part}
                assert got >= set(np.flatnonzero(scores >= least).tolist())
    near = hardnegatives.Index(random.normal(size=(4000, 8)) * 0.01 + np.eye(8)[0], np.arange(4000))
    assert sum(len(r) for r, _ in near.reaching(np.eye(8)[1], lambda: 0.03)) < 400
