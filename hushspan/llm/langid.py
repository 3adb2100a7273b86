"""Language identification by unigrams of pieces, summed over all segmentations of a text.

The pieces are a fixed public vocabulary; each language has its own probabilities for them.  The
probability of a word is the sum over all ways to cut it into pieces, by the forward algorithm, and
that of a text the product over its words, so no segmentation is ever chosen.  A piece of the
vocabulary never crosses the front of a word, hence a word's score is computed once and remembered.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.llm.common import held_out, id_text, settled, text_batches
from hushspan.llm.pieces import SPACE, default_path
from hushspan.llm.texts import slices

FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
#: Bound of the sample to learn from (documents of each language, on average) and rounds of learning.
PER_LANGUAGE, ROUNDS = 1_000, 3
#: Words of fewer characters are summed together, longer ones each alone.
LONG = 32
#: Characters of a long word whose pieces are looked up at once, and steps before sums are rescaled.
STRETCH, RESCALE = 1 << 14, 8
#: Probability of a character that is no piece, the same in every language.
STRANGE = 1e-7
#: Weight of the common distribution in each language's own, so that no known piece is impossible.
SHARED = 1e-3
#: Words that a Python worker remembers before it starts anew, which changes no result.
REMEMBERED = 300_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = re.compile(r"[^\W\d_]")


class Vocabulary:
    """The pieces of a model file, found by a rolling hash of their characters."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        kind = proto.ModelProto.SentencePiece.NORMAL
        self.pieces = sorted(p.piece for p in spec.pieces if p.type == kind and SPACE not in p.piece.lstrip(SPACE))
        self.longest = max(map(len, self.pieces))
        hashes = np.array([_hash(_codes([p]))[0] for p in self.pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash; the number of pieces if there is none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], len(self.pieces))

    def lattice(self, sections: list[str]) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, piece) for every stretch of sections of one length."""
        codes = _codes(sections)
        width, out = codes.shape[1], []
        for start in range(width):
            hashes = np.zeros(len(codes), np.uint64)
            for end in range(start + 1, min(width, start + self.longest) + 1):
                hashes = hashes * _BASE + codes[:, end - 1]
                found = self.find(hashes)
                if end == start + 1 or (found < len(self.pieces)).any():
                    out.append((start, end, found))
        return out


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, as rows."""
    joined = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)


def _hash(codes: np.ndarray) -> np.ndarray:
    hashes = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        hashes = hashes * _BASE + column
    return hashes


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _by_length(sections: list[str]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, section in enumerate(sections):
        found.setdefault(len(section), []).append(i)
    return found


def _with_strange(chances: np.ndarray) -> np.ndarray:
    """(pieces + 2, languages): two more rows, for no piece and for a character that is none."""
    none = np.zeros((1, chances.shape[1]))
    return np.concatenate([chances, none, none + STRANGE])


def log_chances(sections: list[str], table: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """(sections, languages) log of the sum over all segmentations; `table` is from _with_strange."""
    out = np.zeros((len(sections), table.shape[1]))
    for length, at in _by_length(sections).items():
        forward = np.zeros((length + 1, len(at), table.shape[1]))
        forward[0] = 1
        for start, end, piece in vocab.lattice([sections[i] for i in at]):
            piece = np.where((piece == len(vocab.pieces)) & (end == start + 1), piece + 1, piece)
            forward[end] += forward[start] * table[piece]
        out[at] = np.log(np.maximum(forward[length], 1e-300))
    return out


def long_log_chances(word: str, table: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """(languages,) log of the sum over all segmentations of one word of any length.

    Only the sums that a piece can still reach are held, and they are rescaled on the way.
    """
    codes, none = _codes([SPACE + word])[0], len(vocab.pieces)
    ahead, logs = np.zeros((vocab.longest + 1, table.shape[1])), np.zeros(table.shape[1])
    ahead[0] = 1
    for at in range(0, len(codes), STRETCH):
        starts = min(STRETCH, len(codes) - at)
        pieces, hashes = np.full((vocab.longest, starts), none), np.zeros(starts, np.uint64)
        for more in range(vocab.longest):
            inside = min(starts, len(codes) - at - more)
            if inside <= 0:
                break
            hashes = hashes[:inside] * _BASE + codes[at + more:at + more + inside]
            pieces[more, :inside] = vocab.find(hashes)
        pieces[0, pieces[0] == none] = none + 1
        for start in range(starts):
            if start % RESCALE == 0:
                logs += np.log(ahead[0])
                ahead /= ahead[0]
            known = np.flatnonzero(pieces[:, start] != none)
            ahead[known + 1] += ahead[0] * table[pieces[known, start]]
            ahead[:-1] = ahead[1:]
            ahead[-1] = 0
    return logs + np.log(ahead[0])


def expected_counts(sections: list[str], counts: np.ndarray, table: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """How often each piece is used in all segmentations, by their probability in one language."""
    used = np.zeros(len(vocab.pieces) + 2)
    for length, at in _by_length(sections).items():
        steps = [(s, e, np.where((p == len(vocab.pieces)) & (e == s + 1), p + 1, p))
                 for s, e, p in vocab.lattice([sections[i] for i in at])]
        forward, backward = np.zeros((length + 1, len(at))), np.zeros((length + 1, len(at)))
        forward[0] = backward[length] = 1
        for s, e, p in steps:
            forward[e] += forward[s] * table[p]
        for s, e, p in reversed(steps):
            backward[s] += table[p] * backward[e]
        share = counts[at] / np.maximum(forward[length], 1e-300)
        for s, e, p in steps:
            used += np.bincount(p, forward[s] * table[p] * backward[e] * share, len(used))
    return used[:-2]


def _edges(codes: np.ndarray, at: int, chance: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, piece) of the possible pieces that start in one stretch of a word, by start."""
    starts, none = min(STRETCH, len(codes) - at), len(vocab.pieces)
    pieces, hashes = np.full((vocab.longest, starts), none), np.zeros(starts, np.uint64)
    for more in range(vocab.longest):
        inside = min(starts, len(codes) - at - more)
        if inside <= 0:
            break
        hashes = hashes[:inside] * _BASE + codes[at + more:at + more + inside]
        pieces[more, :inside] = vocab.find(hashes)
    pieces[0, pieces[0] == none] = none + 1
    start, more = np.nonzero(chance[pieces.T] > 0)
    return start + at, more + 1, pieces[more, start]


def long_expected_counts(word: str, chance: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """How often each piece is used in all segmentations of one word of any length, in one language.

    Held are the logarithms of the sums up to and from every character; pieces are looked up stretch
    by stretch, and the sums that a piece can still reach are rescaled on the way.
    """
    codes = _codes([SPACE + word])[0]
    size = len(codes)
    upto, onward = np.zeros(size + 1), np.zeros(size + 1)
    ahead, scale, here = [1.0] + [0.0] * vocab.longest, 0.0, 0
    for at in range(0, size, STRETCH):
        start, length, piece = _edges(codes, at, chance, vocab)
        for s, n, p in zip(start.tolist(), length.tolist(), chance[piece].tolist()):
            if s != here:
                ahead, here = [*ahead[1:], 0.0], s
                if s % RESCALE == 0:
                    scale += math.log(ahead[0])
                    ahead = [v / ahead[0] for v in ahead]
                upto[s] = scale + math.log(ahead[0])
            ahead[n] += ahead[0] * p
    upto[size] = scale + math.log(ahead[1])
    # The sums from a character on, of the characters behind the one at hand.
    behind, scale = [1.0] + [0.0] * (vocab.longest - 1), 0.0
    used = np.zeros(len(vocab.pieces) + 2)
    for at in reversed(range(0, size, STRETCH)):
        start, length, piece = _edges(codes, at, chance, vocab)
        first = np.searchsorted(start, np.arange(at, min(at + STRETCH, size) + 1)).tolist()
        steps, chances = length.tolist(), chance[piece].tolist()
        for s in reversed(range(at, at + len(first) - 1)):
            total = 0.0
            for i in range(first[s - at], first[s - at + 1]):
                total += chances[i] * behind[steps[i] - 1]
            behind = [total, *behind[:-1]]
            if s % RESCALE == 0:
                scale += math.log(total)
                behind = [v / total for v in behind]
            onward[s] = scale + math.log(behind[0])
        used += np.bincount(piece, np.exp(upto[start] + np.log(chance[piece]) + onward[start + length] - upto[size]), len(used))
    return used[:-2]


def _counted(path: str, languages: list[str], chances: np.ndarray):
    """Expected piece counts of each language's texts in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, number = vocabulary(path), {name: i for i, name in enumerate(languages)}
        table = _with_strange(chances)
        totals = np.zeros((len(languages), len(vocab.pieces)))
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in slices(texts):
                words: dict[str, Counter] = {}
                for name, text in zip(names[part], texts[part]):
                    words.setdefault(name, Counter()).update(text.split())
                for name, found in words.items():
                    chance, keys = table[:, number[name]], [w for w in found if len(w) < LONG]
                    totals[number[name]] += expected_counts(
                        [SPACE + w for w in keys], np.array([found[w] for w in keys], float), chance, vocab)
                    for word, n in found.items():
                        if len(word) >= LONG:
                            totals[number[name]] += n * long_expected_counts(word, chance, vocab)
        lang, piece = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang), pa.array(piece), pa.array(totals[lang, piece])], ["lang", "piece", "n"])

    return run


class Model:
    """Languages and, for each, the probabilities of the vocabulary's pieces."""

    def __init__(self, languages: list[str], chances: np.ndarray, path: str):
        self.languages, self.chances, self.path = languages, chances, path


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        path: str | None = None) -> Model:
    """Learn from a bounded sample of the documents outside the held-out fold that name a language.

    What comes to the driver is one number for each language and piece.
    """
    path = path or default_path()
    vocab = vocabulary(path)
    known = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & ~held_out("id", FOLDS, HELD_OUT))
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    size = len(vocab.pieces)
    chances = np.full((size, len(languages)), 1 / size)
    if not languages:
        return Model([], chances, path)
    share = F.create_map(*[F.lit(v) for name in languages for v in (name, min(1.0, PER_LANGUAGE / totals[name]))])
    draw = F.pmod(F.xxhash64(id_text("id"), F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    sample = settled(known.where(F.col("text").isNotNull() & (draw < share[F.col("lang")])).select("lang", "text"))
    for _ in range(ROUNDS):
        rows = (text_batches(sample).mapInArrow(_counted(path, languages, chances), "lang long, piece long, n double")
                .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas())
        used = np.zeros((size, len(languages)))
        used[rows["piece"].to_numpy(int), rows["lang"].to_numpy(int)] = rows["n"].to_numpy(float)
        own = (used + 1e-9) / (used + 1e-9).sum(axis=0)
        common = (used.sum(axis=1) + 0.1) / (used.sum(axis=1) + 0.1).sum()
        # Sums of floating-point numbers differ in their last bits with the order of the rows.
        chances = np.float32((1 - SHARED) * own + SHARED * common[:, None]).astype(float)
    return Model(languages, chances, path)


class Scorer:
    """Scores words with a memory; one for each task."""

    def __init__(self, model: Model):
        self.vocab, self.table = vocabulary(model.path), _with_strange(model.chances)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.logs = np.zeros((0, self.table.shape[1]))

    def totals(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) log-probabilities."""
        words = [t.split() for t in texts]
        new = set().union(*words).difference(self.place)
        if len(self.place) + len(new) > REMEMBERED:
            self.clear()
            new = set().union(*words)
        short, long = sorted(w for w in new if len(w) < LONG), sorted(w for w in new if len(w) >= LONG)
        fresh = log_chances([SPACE + w for w in short], self.table, self.vocab)
        alone = [long_log_chances(w, self.table, self.vocab)[None] for w in long]
        new, fresh = short + long, np.concatenate([fresh, *alone])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.logs = np.concatenate([self.logs, fresh])
        place = self.place.__getitem__
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, w in enumerate(words):
            if w:
                out[i] = self.logs[np.fromiter(map(place, w), int, len(w))].sum(axis=0)
        return out


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; the score is the posterior of the language, all alike before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                some = texts[part]
                names, scores = [UNKNOWN] * len(some), np.zeros(len(some))
                if model.languages:
                    logs = scorer.totals([t or "" for t in some])
                    best = logs.argmax(axis=1)
                    sure = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    for i, t in enumerate(some):
                        if t and _LETTER.search(t):
                            names[i], scores[i] = model.languages[best[i]], sure[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(some)), pa.array(names), pa.array(scores)],
                    ["doc_id", "lang_pred", "score"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return text_batches(given).mapInArrow(run, f"doc_id {dict(given.dtypes)['doc_id']}, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `docs`.

    `und` with score 0 stands for a null text, one without a letter, and any text if no document
    names a language to learn.  Equal scores go to the first language by code point.  Repeated rows
    are scored each; other columns are not read.
    """
    return predict(docs, fit(docs, doc_id, text, lang), doc_id, text).select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")


def in_known_languages(docs: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text",
                       lang: str = "lang") -> DataFrame:
    """`docs` without the rows whose language is `und` or less certain than `least`; all columns stay."""
    model = fit(docs, doc_id, text, lang)
    names = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    at = names.index(dict(zip(docs.columns, names))[text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for part in slices(texts):
                some = texts[part]
                keep = np.array([bool(t and _LETTER.search(t)) for t in some]) & bool(model.languages)
                if keep.any():
                    logs = scorer.totals([t or "" for t in some])
                    keep &= 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1) >= least
                kept = batch.slice(part.start, len(some)).filter(pa.array(keep))
                if kept.num_rows:
                    yield kept

    return text_batches(renamed).mapInArrow(run, renamed.schema).toDF(*docs.columns)
