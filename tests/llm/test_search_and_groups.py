"""Top-k search, SimHash, vectors and components against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hushspan.llm import crosspolytope, maxscore, simhash
from hushspan.llm.components import connected_components
from tests.llm.helpers import awkward, clashing, docs, rows

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_chain_star_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (200, None)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    clean = [(a, b) for a, b in links if b is not None and a != b]
    assert got == plain_components({n for link in clean for n in link}, clean)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_simhash(given):
    fps = {f for f in (slow_fingerprint(t) for _, t in given)}
    links = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    roots = plain_components(fps, links)
    first = {}
    for i, t in given:
        root = roots[slow_fingerprint(t)]
        if i is not None:
            first[root] = min(first.get(root, i), i)
    return sorted(((i, f"{slow_fingerprint(t):016x}", first.get(roots[slow_fingerprint(t)])) for i, t in given), key=repr)


def test_simhash_equals_brute_force(spark):
    random.seed(3)
    base = [f"w{random.randrange(900)}" for _ in range(400)]
    given = [(100 + n, " ".join(w if random.random() > 0.002 else "ÄNDERED x" for w in base)) for n in range(60)]
    given += [(200 + n, " ".join(random.choices(base, k=20))) for n in range(40)]
    table = docs(spark, [(i, t, None, None) for i, t in given]).union(awkward(spark))
    want = slow_simhash([(r.doc_id, r.text) for r in table.collect()])
    assert rows(simhash.near_duplicates(clashing(table))) == want
    assert any(c != i for i, _, c in want if i and i >= 100)


@pytest.mark.parametrize("crowd", [0, 64])
def test_simhash_links_join_what_all_pairs_join(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    random.seed(crowd)
    centres = [random.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in random.sample(range(64), random.randrange(4))) for c in centres for _ in range(40)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    every = [(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    nodes = [s for s, in signed]
    assert plain_components(nodes, [tuple(r) for r in links]) == plain_components(nodes, every)
    assert set(map(tuple, links)) <= {x for a, b in every for x in ((a, b), (b, a))}


def test_pivot_tables_keep_plans_small(spark):
    """The distance table and the keys are data that tasks make, not columns whose terms every plan repeats."""
    fps = [0, 1, 3, 7 << 20, -1, (1 << 63) - 1, 0x123456789ABCDEF]
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    keyed = spark.createDataFrame([(f,) for f in fps], "fp long").mapInArrow(
        simhash._keyed, "fp long, d0 long, d1 long, d2 long, d3 long, d4 long, key long").collect()
    assert len(keyed) == 10 * len(fps)
    for r in keyed:
        far = [(r.fp % (1 << 64) ^ p).bit_count() for p in simhash.PIVOTS]
        assert [r.d0] == far[:1] and [w >> 8 * k & 255 for w in r[2:6] for k in range(8)] == far[1:]
    agree = {(a.fp, b.fp) for a in keyed for b in keyed if a.key == b.key}
    assert {(0, 1), (0, 3), (1, 3)} <= agree and (0, -1) not in agree


def test_one_of_each_keeps_columns_and_one_row(spark):
    table = awkward(spark)
    kept = simhash.one_of_each(table)
    assert kept.dtypes == table.dtypes
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 10, 11] and ids.count(None) == 1


def test_near_copies_of_similarity_0_8_leave_one(spark, monkeypatch):
    from hushspan.llm import shingles

    random.seed(12)
    made, far = [], []
    for group in range(30):
        words = [f"w{random.randrange(10**6)}" for _ in range(200)]
        made.append((10 * group, " ".join(words)))
        for copy in range(1, 4):
            other = list(words)
            for at in range(20, 20 + 50 * copy, 50):
                other[at] = f"x{random.randrange(10**6)}"
            made.append((10 * group + copy, " ".join(other)))
        changed = [w if i % 9 else f"y{random.randrange(10**6)}" for i, w in enumerate(words)]
        far.append((10 * group + 5, " ".join(changed)))
    table = docs(spark, [(i, text, "en", "a") for i, text in made + far])
    want = sorted([10 * g for g in range(30)] + [i for i, _ in far])
    assert sorted(r.doc_id for r in shingles.one_of_each(clashing(table)).collect()) == want
    monkeypatch.setattr(shingles, "CROWD", 1)
    assert sorted(r.doc_id for r in shingles.one_of_each(table).collect()) == want
    twice = docs(spark, [(1, "a b c d e f", "en", "a"), (1, "g h i j k l", "en", "a"), (2, "g h i j k l", "en", "a"), (None, "a b", "en", "a")])
    assert sorted((r.doc_id or 0, r.text) for r in shingles.one_of_each(twice).collect()) == [
        (0, "a b"), (1, "a b c d e f"), (1, "g h i j k l")]


def test_empty_tables(spark):
    nothing = awkward(spark).limit(0)
    assert simhash.near_duplicates(nothing).count() == 0
    vectors = spark.createDataFrame([], VECTORS)
    assert maxscore.top_k(vectors, F.col("vec_id") % 100 == 0).count() == 0
    assert crosspolytope.near_duplicates(vectors).count() == 0


def vectors(spark):
    random_ = np.random.default_rng(5)
    made = [(i, [float(x) for x in random_.standard_normal(16)]) for i in range(0, 400)]
    made += [(1000 + i, [x + 0.02 * random_.standard_normal() for x in made[i % 7][1]]) for i in range(60)]
    made += [(2000 + i, made[3][1]) for i in range(20)] + [(300, made[300][1])]
    made += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0, None]), (3004, []), (3005, [1.0, 2.0]),
             (3006, [float("inf")] * 16), (None, [1.0] * 16), (3100, [2.0, 4.0])]
    return spark.createDataFrame([(i, v, 0) for i, v in made], VECTORS)


def takes_part(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 100)
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(maxscore, "STRIDE", 16)
    table = vectors(spark)
    got = rows(maxscore.top_k(clashing(table), F.col("vec_id") % 100 == 0))
    given = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in table.collect() if r.vec_id is not None and takes_part(r.embedding)]
    want = []
    for q, v in {(i, tuple(v)) for i, v in given if i % 100 == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in given if i != q))[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert got == sorted(want, key=repr)


def test_top_k_beyond_double_precision(spark):
    table = spark.createDataFrame([(i * 50, [1e12 + i, -3e12, float(i)], 0) for i in range(6)], "vec_id long, embedding array<double>, label int")
    got = rows(maxscore.top_k(table, F.col("vec_id") == 0, k=2))
    assert [g[3] for g in got] == [(1 << 63) - 1] * 2 and [g[2] for g in got] == [50, 100]


@pytest.mark.parametrize("piece,small", [(2048, 32), (8, 4)])
def test_vector_groups_equal_brute_force(spark, monkeypatch, piece, small):
    monkeypatch.setattr(crosspolytope, "PIECE", piece)
    monkeypatch.setattr(crosspolytope, "SMALL", small)
    table = vectors(spark)
    got = rows(crosspolytope.near_duplicates(clashing(table)))
    given = [(r.vec_id, r.embedding) for r in table.collect()]
    use = [n for n, (i, v) in enumerate(given) if i is not None and takes_part(v) and any(v)]
    links, count = [], dict.fromkeys(range(len(given)), 0)
    for x in use:
        for y in use:
            a, b = np.array(given[x][1]), np.array(given[y][1])
            if x != y and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                count[x] += 1
                links.append((given[x][0], given[y][0]))
    roots = plain_components({i for i, _ in given if i is not None}, links)
    want = [(i, count[n], roots.get(i), i is None or roots[i] == i) for n, (i, _) in enumerate(given)]
    want = sorted(((i, c, r, k) for i, c, r, k in want), key=repr)
    by_id = lambda given_: sorted(((i, c, r, k) for i, c, r, k in given_ if i != 300), key=repr)
    assert by_id(got) == by_id(want)
    assert sum(c for _, c, _, _ in want) > 1000
