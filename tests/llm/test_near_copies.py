"""Near copies by shingles against all pairs: crowds that are alike and crowds that are not."""

from __future__ import annotations

import random

import pytest

from hushspan.llm import shingles
from tests.llm.helpers import awkward, clashing, docs
from tests.llm.test_texts import plain_copies


def words(count, seed):
    random.seed(seed)
    return ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(count)]


def edited(base, count):
    out = list(base)
    for at in random.sample(range(len(out)), count):
        out[at] = f"e{random.randrange(10**9)}"
    return out


def groups(spark, texts):
    table = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    rows = shingles.near_copies(table).collect()
    first = {}
    for r in rows:
        first[r.root] = min(first.get(r.root, r.doc_id), r.doc_id)
    return {r.doc_id: first[r.root] for r in rows}


@pytest.mark.parametrize("crowd", [2, 32])
def test_equal_to_all_pairs(spark, monkeypatch, crowd):
    """A crowd of near copies of one text, some too far from it; one that shares a passage only; copies of copies."""
    monkeypatch.setattr(shingles, "CROWD", crowd)
    base, passage = words(140, 1), words(60, 2)
    texts = [" ".join(base)] + [" ".join(edited(base, random.randrange(1, 7))) for _ in range(90)]
    texts += [" ".join(passage + words(random.randrange(5, 40), 100 + i)) for i in range(80)]
    chain = words(120, 3)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(chain, 2)
    texts += [" ".join(words(30, 50 + i % 5)) for i in range(20)] + ["one two", "one two", "", "Two  words", "two words", None]
    found, wanted = groups(spark, texts), plain_copies(dict(enumerate(texts)))
    assert found == wanted
    assert len(set(wanted.values())) > 80 and max(list(wanted.values()).count(g) for g in set(wanted.values())) > 30


def test_without_the_text_they_were_made_from(spark, monkeypatch):
    monkeypatch.setattr(shingles, "CROWD", 8)
    base = words(150, 4)
    texts = [" ".join(edited(base, 1 + i % 3)) for i in range(70)]
    assert groups(spark, texts) == plain_copies(dict(enumerate(texts)))


def test_the_front_loses_no_pair(spark):
    random.seed(6)
    sets = [sorted(random.sample(range(60), random.randrange(1, 30))) for _ in range(60)]
    sets += [sorted(set(s[1:]) | {99}) for s in sets]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "whole long, found array<long>")
    front = {}
    for r in shingles._front(table, 0.8).collect():
        front.setdefault(r.whole, {})[r.key] = r.p
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(set(a) & set(b))
            if both >= 0.8 * (len(a) + len(b) - both):
                shared = [k for k in front.get(i, {}) if k in front.get(j, {})]
                assert any(min(len(a) - front[i][k], len(b) - front[j][k]) >= 0.8 / 1.8 * (len(a) + len(b)) - 1e-9 for k in shared)


def test_one_of_each_on_awkward_rows(spark):
    table = awkward(spark).unionByName(docs(spark, [(50, "word0 " * 5 + "x", "en", "a"), (51, None, "en", "a"), (52, "\t", "en", "b")]))
    kept = shingles.one_of_each(clashing(table))
    assert kept.columns == clashing(table).columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    # Equal texts (1, 2, 2) leave one, wordless ones (3, 4, 5, 51, 52) leave one, the row without an id stays.
    assert [i for _, i in ids] == [1, 3, 6, 7, 8, 9, 10, 11, 50, None]
    assert shingles.one_of_each(table.limit(0)).count() == 0


def test_the_stage_joins_what_simhash_links(spark):
    """Texts of one repeated passage with tails of their own: equal in most shingles, not in their set of shingles."""
    import corpus_pipeline

    passage = " ".join(words(31, 7)) + " "
    texts = [passage * 60 + " ".join(words(80, 20 + i)) for i in range(3)] + [" ".join(words(90, 40 + i)) for i in range(3)]
    table = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    assert set(plain_copies(dict(enumerate(texts))).values()) == set(range(6))
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, table, "").collect()) == [0, 3, 4, 5]
