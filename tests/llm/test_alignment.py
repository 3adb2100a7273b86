"""Token groups and pair counts against their definition, text by text."""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hushspan.llm import alignment
from tests.llm.helpers import awkward, clashing, docs, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoders():
    byte_level, sentence = alignment.default_paths()
    a = Tokenizer.from_file(byte_level)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=sentence)
    letters = alignment.byte_characters()

    def both(text):
        """(id, bytes) of every token of both, or nothing."""
        if not text:
            return [], []
        one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
               for i in b.encode(text)]
        data = (" " + text).encode()
        return (one, two) if all(b"".join(t for _, t in ts) == data for ts in (one, two)) else ([], [])

    return both


def cut(tokens, ends):
    """The ids of one side, in runs that close with one of `ends`."""
    runs, run = [], []
    for end, i in tokens:
        run.append(i)
        if end in ends:
            runs.append(run)
            run = []
    return runs


def plain(given, both):
    """All columns of the report by ends of tokens, held in plain lists."""
    parted = []
    for doc_id, text in given:
        ends = []
        for tokens in both(text):
            at, out = 0, []
            for i, data in tokens:
                at += len(data)
                out.append((at, i))
            ends.append(out)
        common = {e for e, _ in ends[0]} & {e for e, _ in ends[1]}
        groups = list(zip(cut(ends[0], common), cut(ends[1], common)))
        by_end = dict(ends[1])
        links = [(i, by_end[e]) for e, i in ends[0] if e in by_end]
        parted.append((doc_id, len(ends[0]), len(ends[1]), groups, links))
    counts = Counter(link for *_, links in parted for link in links)
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for doc_id, n_a, n_b, groups, links in parted:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), digest, sum(counts[x] == most[x[1]] for x in links),
                    sum(counts[x] for x in links)))
    return sorted(out, key=repr)


def reported(table):
    return rows(alignment.report(table).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"))


def test_awkward_texts(spark, encoders):
    texts = ["<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", " ", "  two  spaces \t\n\n x", "naïve café 😀👩‍👩‍👧 日本語 ελληνικά",
             "\u0000 null ​ wide　space", "don't I'll we've", "x" * 3000, "한국어 텍스트", "1234567890" * 20, "\n", "\r\n", "é"]
    table = awkward(spark).unionByName(docs(spark, [(100 + i, t, "en", "s") for i, t in enumerate(texts)]))
    given = [(r.doc_id, r.text) for r in table.collect()]
    assert reported(table) == plain(given, encoders)
    assert reported(clashing(table)) == plain(given, encoders)
    assert reported(table.limit(0)) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data")
def test_whole_table(spark, encoders):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    given = [(r.doc_id, r.text) for r in table.collect()]
    assert reported(table) == plain(given, encoders)


def test_groups_give_tokens_and_bytes_back(spark, encoders):
    table = awkward(spark)
    want = ["a_ids", "b_ids", "a_upto", "b_upto", "byte_ends", "links"]
    known = alignment.vocabularies(*alignment.default_paths())
    b_ids = known.b_of_pairs()
    for row in alignment.aligned(table, want, ["doc_id", "text"]).collect():
        one, two = encoders(row.text)
        assert row.a_ids == [i for i, _ in one] and row.b_ids == [i for i, _ in two]
        data = (" " + (row.text or "")).encode()
        for low_a, a, low_b, b, low, end, link in zip([0, *row.a_upto], row.a_upto, [0, *row.b_upto], row.b_upto,
                                                      [0, *row.byte_ends], row.byte_ends, np.frombuffer(row.links, "<i4")):
            assert b"".join(t for _, t in one[low_a:a]) == b"".join(t for _, t in two[low_b:b]) == data[low:end]
            assert b_ids[link] == two[b - 1][0]
        if one:
            assert (row.a_upto[-1], row.b_upto[-1], row.byte_ends[-1]) == (len(one), len(two), len(data))


def test_equal_lengths_stand_for_equal_bytes_only_where_that_is_so():
    known = alignment.vocabularies(*alignment.default_paths())
    assert known.lossless
    texts = ["a▁b", "▁", "plain", "é😀", "<0x41>", " ▁ ", "x\u2581\u2581", "\u0000"]
    ids = [(np.array(known.a.encode(" " + t).ids), np.array(known.b.encode(t))) for t in texts]
    quick = [known.give_back(" " + t, *i) for t, i in zip(texts, ids)]
    known.lossless = False
    try:
        assert quick == [known.give_back(" " + t, *i) for t, i in zip(texts, ids)]
    finally:
        known.lossless = True
    assert quick == ["▁" not in t for t in texts]


def test_words_are_encoded_as_in_their_text():
    known = alignment.vocabularies(*alignment.default_paths())
    assert known.by_word
    random = np.random.default_rng(5)
    parts = ["a", "word", "I'll", "'s", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\u0085", "\u200b",
             "\u180e", "\x1c", "é", "ɏ", "Ω", "日本", "😀", "12", "...", "-", "<|endoftext|>", "\u00ad", "×", "_", "\ufeff", "İ", "\u0000"]
    texts = ["".join(random.choice(parts, int(n))) for n in random.integers(0, 30, 3000)]
    for text, a, b in zip(texts, *known.encode(texts)):
        assert a.tolist() == known.a.encode(" " + text, add_special_tokens=False).ids
        assert b.tolist() == known.b.encode(text) or not text


def test_pointer_jumping_over_long_chains():
    """Tokens of two bytes, one byte apart, overlap in a single chain up to the common end."""
    for length in (2, 10, 4096):
        a = np.arange(2, length + 1, 2)
        b = np.append(np.arange(1, length, 2), length)
        assert set(alignment.terminals(a, b)[0].tolist()) == {len(a) + len(b) - 1}
    random = np.random.default_rng(1)
    for _ in range(200):
        size = int(random.integers(1, 60))
        a, b = (np.append(np.flatnonzero(random.random(size - 1) < 0.5) + 1, size) for _ in range(2))
        common = np.intersect1d(a, b)
        wanted = np.concatenate([np.searchsorted(common, a), np.searchsorted(common, b)])
        found = alignment.terminals(a, b)[0]
        assert np.searchsorted(common, b[found - len(a)]).tolist() == wanted.tolist()
    assert alignment.terminals(np.empty(0, int), np.empty(0, int))[0].tolist() == []


def test_every_pair_of_ids_has_its_own_number():
    known = alignment.vocabularies(*alignment.default_paths())
    by_end = {}
    for j, data in enumerate(known.b_bytes):
        if not known.b.is_control(j) and not known.b.is_unknown(j):
            by_end.setdefault(data, []).append(j)
    a, b = [], []
    for i, token in enumerate(known.a_bytes):
        for n in range(1, len(token) + 1):
            for j in by_end.get(token[-n:], []):
                a.append(i)
                b.append(j)
    owner = {t: i for i, t in enumerate(known.a_bytes) if t}
    for data, ids in by_end.items():
        for n in range(1, len(data)):
            if data[-n:] in owner:
                for j in ids:
                    a.append(owner[data[-n:]])
                    b.append(j)
    numbers = known.pair(np.array(a), np.array(b))
    assert len(set(numbers.tolist())) == len(set(zip(a, b))) and numbers.max() < known.size < 700_000
    assert (known.b_of_pairs()[numbers] == np.array(b)).all()
