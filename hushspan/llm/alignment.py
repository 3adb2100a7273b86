"""Alignment of two tokenizers over the same bytes, by pointer jumping.

Tokenizer A is a byte-level BPE, B a SentencePiece model.  Every token points to the token that overlaps
it and reaches farthest to the right; replacing each pointer by the pointer's own pointer doubles the
distance covered, so after a logarithmic number of rounds every token names the last token of its
group, where both tokenizers end together.  All documents of a batch are aligned at once.

How often a pair of ids ends together is counted over the whole corpus.  Of such a pair one token's
bytes end in the other's, so the vocabularies alone bound the number of pairs (`Vocabularies.size`, some
600,000 here), whatever the corpus: their counts may be sent to every task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.llm import pieces
from hushspan.llm.common import shared_folder, text_batches
from hushspan.llm.texts import slices

#: Characters of text that are aligned at once; one longer text is aligned alone.
AT_ONCE = 1 << 19
#: Places where white space follows a character that surely is none.
_CUT = re.compile("(?<=[!-~¡-ɏ])(?=[ \n])")


def byte_characters() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, the bytes of their entries, and a number for every pair of ids that can end together."""

    def __init__(self, byte_level: str, sentence: str):
        # One thread for each task: Spark deals the cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        with open(byte_level, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        to_byte = byte_characters()
        size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.a_bytes = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                self.a_bytes[i] = bytes(to_byte[c] for c in token)
        model = pieces.model(sentence)
        self.b = model.library
        self.b_bytes, is_byte = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            is_byte.append(self.b.is_byte(i))
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if is_byte[-1] else piece.replace(pieces.SPACE, " ").encode())
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        self.b_is_byte = np.array(is_byte)
        #: A pair's number is a place of its longer token's own range: how long the shorter one is, and
        #: 0 for a byte piece, whose bytes a plain piece may have too.
        self.a_base = np.concatenate([[0], np.cumsum(self.a_length + 1)])
        self.b_base = self.a_base[-1] + np.concatenate([[0], np.cumsum(self.b_length)])
        self.size = int(self.b_base[-1])
        named = [t for t in self.a_bytes if t]
        plain = [t for t, b in zip(self.b_bytes, is_byte) if not b]
        if len(set(named)) < len(named) or len(set(plain)) < len(plain):
            raise ValueError("two entries of a vocabulary have the same bytes")
        #: Neither normalises and both know every byte, so tokens are stretches of the text itself, but for
        #: an escaped space in the text, which B shortens: equal lengths then mean equal bytes.
        self.lossless = (self.a.normalizer is None and spec["pre_tokenizer"]["type"] == "ByteLevel"
                         and spec["model"]["type"] == "BPE" and set(to_byte) <= set(spec["model"]["vocab"])
                         and not model.map.units and not model.squeeze and model.dummy_prefix and sum(is_byte) == 256)
        #: A's pre-tokenizer ends a piece wherever white space follows anything else, and its merges stay
        #: inside a piece; no piece of B holds a space or line end after another character.  So what lies
        #: between such places is encoded once in a task and remembered.
        self.by_word = (self.lossless and model.by_word and spec["pre_tokenizer"].get("use_regex", True)
                        and not spec["pre_tokenizer"]["add_prefix_space"] and not spec.get("truncation")
                        and all(t.get("special") for t in spec.get("added_tokens", [])))
        self.model, self.words = model, pieces.Memory()
        #: What an id adds to a digest: itself and what follows, for A a comma or bar, for B a comma or semicolon.
        self.texts = [b"%d%s" % (i, mark) for mark, count in ((b",", size), (b"|", size), (b",", len(self.b_bytes)),
                                                             (b";", len(self.b_bytes))) for i in range(count)]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair of ids, one of which ends in the other."""
        la, lb = self.a_length[a], self.b_length[b]
        return np.where(la >= lb, self.a_base[a] + np.where(self.b_is_byte[b], 0, lb), self.b_base[b] + la - 1)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A's ids of each text with a space before it, and B's of each text."""
        if not self.by_word:
            a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
            return [np.array(e.ids, np.int32) for e in a], [np.array(i, np.int32) for i in self.b.encode(texts, num_threads=1)]
        # An escaped space in a text is no space: such a text is not given back, whatever its ids.
        split = [_CUT.split(" " + t) if pieces.SPACE not in t else [] for t in texts]
        if new := sorted(self.words.unknown(set().union(*split))):
            # B adds a space itself, in place of the word's own or, before a line end, as a first id too many.
            for word, a, b in zip(new, self.a.encode_batch_fast(new, add_special_tokens=False),
                                  self.b.encode([w.removeprefix(" ") for w in new], num_threads=1)):
                b = b[word[:1] != " ":] if word != " " else [self.model.space_id]
                self.words[word] = (array("i", a.ids).tobytes(), array("i", b).tobytes())
        out: tuple[list, list] = ([], [])
        for words in split:
            found = [self.words[w] for w in words]
            for ids, side in zip(out, (0, 1)):
                ids.append(np.frombuffer(b"".join([f[side] for f in found]), np.int32))
        return out

    def give_back(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        """Are the bytes of both sides' tokens those of the text?"""
        if self.lossless:
            size = len(text) if text.isascii() else len(text.encode())
            return int(self.a_length[a].sum()) == size == int(self.b_length[b].sum())
        data = text.encode()
        return all(b"".join(map(table.__getitem__, ids.tolist())) == data
                   for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def b_of_pairs(self) -> np.ndarray:
        """The id of B in each pair, -1 for numbers that no pair has."""
        out = np.full(self.size, -1, np.int64)
        plain = {t: i for i, t in enumerate(self.b_bytes) if not self.b_is_byte[i]}
        single = {t: i for i, t in enumerate(self.b_bytes) if self.b_is_byte[i]}
        for i, token in enumerate(self.a_bytes):
            base = int(self.a_base[i])
            out[base] = single.get(token[-1:], -1)
            for n in range(1, len(token) + 1):
                out[base + n] = plain.get(token[-n:], -1)
        out[self.a_base[-1]:] = np.repeat(np.arange(len(self.b_bytes)), self.b_length)
        return out


@lru_cache(maxsize=2)
def vocabularies(byte_level: str, sentence: str) -> Vocabularies:
    """Both vocabularies, read once in each Python worker."""
    return Vocabularies(byte_level, sentence)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and then of B the last token of its group, by doubling of successors; and the
    token of A that covers the last byte of each token of B.

    `a_ends` and `b_ends` are where the tokens end, rising to the same last byte.  A token of A points
    to the token of B that covers its last byte.  One of B points back to the token of A that covers its
    last byte and ends behind it; where none does, both end together and it points to itself.
    """
    to_b = len(a_ends) + np.searchsorted(b_ends, a_ends)
    to_a = np.searchsorted(a_ends, b_ends)
    own = len(a_ends) + np.arange(len(b_ends))
    at = np.concatenate([to_b, np.where(a_ends[to_a] > b_ends, to_a, own)]) if len(b_ends) else to_b
    while True:
        after = at[at]
        if np.array_equal(after, at):
            return at, to_a
        at = after


class Aligned:
    """The tokens of some texts, one text after the other, and their groups.

    Texts without tokens (empty, or not the bytes of their tokens) take no room.
    """

    def __init__(self, known: Vocabularies, texts: list[str]):
        a_ids, b_ids = known.encode(texts)
        for i, text in enumerate(texts):
            if not text or not known.give_back(" " + text, a_ids[i], b_ids[i]):
                a_ids[i] = b_ids[i] = np.empty(0, np.int32)
        self.known = known
        self.a_from, self.b_from = _starts(a_ids), _starts(b_ids)
        self.a, self.b = _flat(a_ids), _flat(b_ids)
        self.a_ends, self.b_ends = np.cumsum(known.a_length[self.a]), np.cumsum(known.b_length[self.b])
        label, to_a = terminals(self.a_ends, self.b_ends)
        label -= len(self.a)
        last = label[len(self.a):] == np.arange(len(self.b))
        #: The group of each token, and the last token of B and of A of each group.
        number = np.cumsum(last) - 1
        self.a_group, self.b_group = number[label[:len(self.a)]], number[label[len(self.a):]]
        self.b_last = np.flatnonzero(last)
        self.a_last = to_a[self.b_last]
        self.group_from = np.searchsorted(self.b_last, self.b_from)
        self.links = known.pair(self.a[self.a_last], self.b[self.b_last])

    def digests(self) -> list[str]:
        """SHA-256 of each text's ids in groups; empty for a text without tokens."""
        known, a_size = self.known, len(self.known.a_bytes)
        marked = np.empty(len(self.a) + len(self.b), np.int64)
        a_kind, b_kind = self.a + 0, self.b + 2 * a_size
        a_kind[self.a_last] += a_size
        b_kind[self.b_last] += len(known.b_bytes)
        # Before a token of A stand the tokens of B of earlier groups, before one of B those of A up to its own.
        b_before = np.concatenate([[0], self.b_last + 1])
        marked[np.arange(len(self.a)) + b_before[self.a_group]] = a_kind
        marked[np.arange(len(self.b)) + self.a_last[self.b_group] + 1] = b_kind
        ends = self.a_from + self.b_from
        out = []
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            text = b"".join(map(known.texts.__getitem__, marked[start:end].tolist()))
            out.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
        return out

    def column(self, name: str) -> pa.Array:
        """One of KINDS, with a value for each text."""
        groups = self.group_from
        if name in ("n_groups", "n_links"):
            return pa.array(np.diff(groups), pa.int64())
        if name == "n_a" or name == "n_b":
            return pa.array(np.diff(self.a_from if name == "n_a" else self.b_from), pa.int64())
        if name == "groups_sha256":
            return pa.array(self.digests(), pa.string())
        if name in ("a_ids", "b_ids"):
            ids, starts = (self.a, self.a_from) if name == "a_ids" else (self.b, self.b_from)
            return _lists(starts, ids)
        if name == "links":
            data = np.ascontiguousarray(self.links, "<i4").tobytes()
            return pa.array([data[4 * i:4 * j] for i, j in zip(groups[:-1].tolist(), groups[1:].tolist())], pa.binary())
        base = {"a_upto": (self.a_last + 1, self.a_from), "b_upto": (self.b_last + 1, self.b_from),
                "byte_ends": (self.b_ends[self.b_last], np.concatenate([[0], self.b_ends])[self.b_from])}[name]
        return _lists(groups, base[0] - np.repeat(base[1][:-1], np.diff(groups)))


def _starts(lists: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(ids) for ids in lists])]).astype(np.int64)


def _flat(lists: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *lists])


def _numbers(links: pa.Array) -> np.ndarray:
    """The numbers of all rows, one after the other."""
    return np.frombuffer(b"".join(links.to_pylist()), "<i4")


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


#: What can be asked for: counts; the digest; the numbers of the pairs that end together, four bytes each,
#: the low one first, which Spark passes on as they are; the ids; and for
#: each group how many tokens of A and B, and how many bytes with the space before the text, end with it.
KINDS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string",
         "links": "binary", "a_ids": "array<int>", "b_ids": "array<int>", "a_upto": "array<int>",
         "b_upto": "array<int>", "byte_ends": "array<int>"}


def aligned(docs: DataFrame, want: list[str], keys: list[str], text: str = "text",
            paths: tuple[str, str] | None = None) -> DataFrame:
    """`keys` of every row and the columns of KINDS in `want`.

    A text is encoded with a space before it (B's model adds the space itself) and without special
    tokens.  Null and empty texts, and those that either tokenizer's bytes do not give back, have no
    tokens: zeros, empty lists and an empty digest.  Rows are handled one by one, so repeated rows and
    ties need nothing special; other columns are not read.  `paths` are the two vocabulary files,
    which every executor must have.
    """
    paths = paths or default_paths()
    names = [f"k{i}" for i in range(len(keys))]
    given = docs.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = dict(given.dtypes)
    schema = ", ".join([f"{n} {kinds[n]}" for n in names] + [f"{w} {KINDS[w]}" for w in want])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(*paths)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for part in slices(texts, AT_ONCE):
                found = Aligned(known, texts[part])
                kept = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [kept.column(i) for i in range(len(names))] + [found.column(w) for w in want], names + want)

    return text_batches(given).mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keys)))


def pair_counts(links: DataFrame, size: int) -> np.ndarray:
    """How many links of the whole table (links binary) have each pair's number, `size` of them.

    A task sends one row for each pair that it met, and the driver gets one for each pair.
    """
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0)), minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["pair", "n"])

    found = links.mapInArrow(tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[np.asarray(found["pair"])] = np.asarray(found["n"])
    return counts


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs`.

    `count_sum` adds up, over the links of the text, how many links of the whole table hold the same
    pair of ids; `n_best` are those that no other pair with the same id of B outnumbers.  Texts are
    encoded once: their links are written to the shared folder and read again for both passes.
    Cases without tokens are as in `aligned`.
    """
    paths = paths or default_paths()
    spark = docs.sparkSession
    known = vocabularies(*paths)
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    folder = f"{shared_folder(spark)}/links-{uuid.uuid4().hex}"
    aligned(docs, [*names, "links"], [doc_id], text, paths).withColumnRenamed(doc_id, "doc_id").write.option(
        "compression", "zstd").parquet(folder)
    written = spark.read.parquet(folder)
    counts = pair_counts(written.select("links"), known.size)
    b_ids = known.b_of_pairs()
    most = np.zeros(len(known.b_bytes), np.int64)
    met = np.flatnonzero(counts)
    np.maximum.at(most, b_ids[met], counts[met])
    best = np.zeros(known.size, bool)
    best[met] = counts[met] == most[b_ids[met]]
    sent = spark.sparkContext.broadcast((counts, best))
    kind = dict(written.dtypes)["doc_id"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = sent.value
        for batch in batches:
            links = batch.column(batch.num_columns - 1)
            pairs = _numbers(links)
            bounds = np.concatenate([[0], np.cumsum(pc.binary_length(links))]) // 4
            sums = [np.concatenate([[0], np.cumsum(v, dtype=np.int64)]) for v in (best[pairs], counts[pairs])]
            more = [pa.array(s[bounds[1:]] - s[bounds[:-1]]) for s in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], ["doc_id", *names, "n_best", "count_sum"])

    given = written.select("doc_id", *names, "links")
    schema = f"doc_id {kind}, {', '.join(f'{n} {KINDS[n]}' for n in names)}, n_best long, count_sum long"
    return given.mapInArrow(weigh, schema).withColumnRenamed("doc_id", doc_id)
