"""SentencePiece encoding that keeps every piece's place in the original bytes, and decoding.

The text is normalised as the model file says: at each position the longest prefix that the compiled
character map knows is replaced, white space is escaped, and each byte that comes out remembers how
far in the source it had read.  The merges themselves are the installed library's.  A piece of this
vocabulary never holds an escaped space after another character, so merges never cross the front of a
word: every distinct word is encoded once in a task and remembered.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.llm.common import text_batches

SPACE = "▁"
#: Words of one generation that a Python worker remembers; a full generation becomes the old one and
#: the words of the one before it that were not met again are forgotten, which changes no result.
REMEMBERED = 200_000
#: Characters of text that a task encodes at once.
AT_ONCE = 1 << 20


class CharacterMap:
    """The compiled character map of a model: a double-array trie over UTF-8 and a replacement pool."""

    def __init__(self, blob: bytes):
        self.units, self.pool = (), b""
        if blob:
            length = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{length // 4}I", blob, 4)
            self.pool = blob[4 + length:]
        #: The bytes that some prefix in the map starts with.
        self.fronts = np.zeros(256, bool)
        for byte in range(256) if self.units else ():
            place = self._offset(self.units[0]) ^ byte
            self.fronts[byte] = place < len(self.units) and self.units[place] & 0x800000FF == byte

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Bytes read at `at`, and what they become; one character as it is if no prefix is known."""
        best, units = (0, b""), self.units
        if units:
            node = units[0]
            place = self._offset(node)
            for length in range(1, len(data) - at + 1):
                byte = data[at + length - 1]
                place ^= byte
                if place >= len(units) or units[place] & 0x800000FF != byte:
                    break
                node = units[place]
                place ^= self._offset(node)
                if node >> 8 & 1:
                    start = units[place] & 0x7FFFFFFF
                    best = (length, self.pool[start:self.pool.index(b"\0", start)])
        if best[0]:
            return best
        width = 1
        while at + width < len(data) and data[at + width] & 0xC0 == 0x80:
            width += 1
        return width, data[at:at + width]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class Memory(dict):
    """What the words of this and the last generation became."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def unknown(self, words: set[str]) -> set[str]:
        """Words to look up anew; the others are in this generation afterwards."""
        if len(self) + len(words) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        new = words.difference(self)
        known = new.intersection(self.old)
        self.update((w, self.old[w]) for w in known)
        return new - known


class Model:
    """A SentencePiece model file, with the parts of its normalisation."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        normalizer = spec.normalizer_spec
        self.map = CharacterMap(normalizer.precompiled_charsmap)
        self.dummy_prefix = normalizer.add_dummy_prefix
        self.squeeze = normalizer.remove_extra_whitespaces
        if not normalizer.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that escape white space as a prefix are read")
        pieces = [p.piece for p in spec.pieces]
        is_byte = [p.type == proto.ModelProto.SentencePiece.BYTE for p in spec.pieces]
        self.space_id = self.library.piece_to_id(SPACE)
        #: Characters of each piece; byte pieces are not counted.
        self.n_chars = np.array([0 if b else len(p) for p, b in zip(pieces, is_byte)])
        #: For a byte piece the length of the character that it opens, 0 if it goes on with one.
        self.opens = np.array([_opened(int(p[1:-1], 16)) if b else -1 for p, b in zip(pieces, is_byte)])
        #: Merges stay inside a word only if no piece holds an escaped space after another character,
        #: and inside a line only if no piece holds a line end.
        self.by_word = (not self.map.units and not self.squeeze and self.dummy_prefix
                        and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces))
        self.words, self.after_spaces = Memory(), Memory()
        #: One object for each id, shared by all remembered words.
        self.id_objects = list(range(len(pieces)))

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text; for each of its characters, and its end, the source byte read so far.

        Where no character can start a prefix of the map and no space is dropped, all characters stay and
        their places are read off at once.
        """
        data = text.encode()
        raw = np.frombuffer(data, np.uint8)
        opening = np.flatnonzero(raw & 0xC0 != 0x80)
        drops = self.squeeze and ("  " in text or SPACE in text or text[:1] == " " or text[-1:] == " ")
        if not drops and not self.map.fronts[raw[opening]].any():
            front = [SPACE] * bool(text and self.dummy_prefix)
            return "".join(front) + text.replace(" ", SPACE), np.concatenate([np.zeros(len(front), np.int64), opening, [len(data)]])
        return self.walk(data)

    def walk(self, data: bytes) -> tuple[str, np.ndarray]:
        """`normalize` step by step through the map."""
        out, starts, at = [], [], 0
        while at < len(data):
            width, new = self.map.longest(data, at)
            for char in new.decode():
                char = SPACE if char == " " else char
                if not (self.squeeze and char == SPACE and (not out or out[-1] == SPACE)):
                    out.append(char)
                    starts.append(at)
            at += width
        end = len(data)
        while self.squeeze and out and out[-1] == SPACE:
            out.pop()
            end = starts.pop()
        if out and self.dummy_prefix:
            out.insert(0, SPACE)
            starts.insert(0, starts[0])
        return "".join(out), np.array([*starts, end], np.int64)

    def split(self, text: str) -> tuple[list[str], Memory]:
        """Words that the library encodes independently of each other, and where they are remembered.

        Each stands for itself with one space before it, but in `words` one that starts with a line
        end stands for itself alone.
        """
        parted = text.replace("\n", " \n")
        if "  " not in parted and text[0] != " ":
            return parted.split(" "), self.words
        return _WORD_END.split(text), self.after_spaces

    def remember(self, words: set[str], memory: Memory) -> None:
        """Encode and decode words: (ids, ids as text, decoded); None stands for decoded as it was."""
        todo = sorted(words)
        encoded = self.library.encode(todo, num_threads=1)
        decoded = self.library.decode(encoded, num_threads=1)
        shared = self.id_objects.__getitem__
        for word, ids, back in zip(todo, encoded, decoded):
            ids = tuple(map(shared, ids))
            if memory is self.words and word[:1] == "\n":
                memory[word] = (ids[1:], ",".join(map(str, ids[1:])), None if back == word else back)
            elif not word:
                memory[word] = ((self.space_id,), str(self.space_id), None)
            else:
                memory[word] = (ids, ",".join(map(str, ids)), None if back == word else " " + back)

    def encode(self, texts: list[str]) -> list[tuple[list[int], str, str]]:
        """(ids, ids as text, decoded) of each text, as the library gives them for the whole text."""
        split = [self.split(t) if t and self.by_word and SPACE not in t else None for t in texts]
        for memory in (self.words, self.after_spaces):
            met = set().union(*(s[0] for s in split if s and s[1] is memory))
            if new := memory.unknown(met):
                self.remember(new, memory)
        out = []
        for text, parts in zip(texts, split):
            if parts:
                found = [parts[1][w] for w in parts[0]]
                ids = [i for f in found for i in f[0]]
                decoded = text
                if any(f[2] is not None for f in found):
                    plain = [w if w[:1] == "\n" and parts[1] is self.words else " " + w for w in parts[0]]
                    decoded = "".join([p if f[2] is None else f[2] for p, f in zip(plain, found)])[1:]
                out.append((ids, ",".join([f[1] for f in found]), decoded))
            else:
                ids = self.library.encode(text)
                out.append((ids, ",".join(map(str, ids)), self.library.decode(ids)))
        return out

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every piece in the source; the byte pieces of a character have its span.

        The space that the model puts before a text has no bytes of its own.
        """
        taken = np.asarray(ids, np.int64)
        opens = self.opens[taken]
        normal, places = self.normalize(text)
        upto = np.cumsum(self.n_chars[taken] + (opens > 0))
        if (upto[-1] if len(taken) else 0) != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        first = upto - np.where(opens < 0, self.n_chars[taken], 1)
        return places[first], places[upto]


def _opened(byte: int) -> int:
    if byte < 0x80:
        return 1
    return 0 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


_WORD_END = re.compile("(?<=[^ ]) ")


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """The model, read once in each Python worker."""
    return Model(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: What can be asked for, in this order.
KINDS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "covered_bytes": "long",
         "ids": "array<int>", "starts": "array<long>", "ends": "array<long>", "decoded": "string"}


def _sub_batches(texts: list[str]) -> Iterator[range]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= AT_ONCE or i + 1 == len(texts):
            yield range(start, i + 1)
            start, size = i + 1, 0


def encoded(docs: DataFrame, want: list[str], keys: list[str], text: str = "text",
            path: str | None = None) -> DataFrame:
    """`keys` of every row and the columns of KINDS in `want`.

    `ids` are the ids of the whole text without begin or end, `starts` and `ends` the bytes of the
    source that each piece stands for, `covered_bytes` the end of the last one, `decoded` the text
    made from the ids again.  A null text is encoded as an empty one, which has no pieces.  Rows are
    handled one by one, so repeated rows and ties need nothing special; other columns are not read.
    `path` is the model file, which every executor must have.
    """
    path = path or default_path()
    names = [f"k{i}" for i in range(len(keys))]
    given = docs.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = dict(given.dtypes)
    schema = ", ".join([f"{n} {kinds[n]}" for n in names] + [f"{w} {KINDS[w]}" for w in want])
    spans = bool({"starts", "ends", "covered_bytes"} & set(want))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for part in _sub_batches(texts):
                made: dict[str, list] = {w: [] for w in want}
                some = texts[part.start:part.stop]
                for source, (ids, id_text, decoded) in zip(some, coder.encode(some)):
                    starts, ends = coder.spans(source, ids) if spans else (None, None)
                    for w in want:
                        made[w].append(
                            len(ids) if w == "n_tokens"
                            else hashlib.sha256(id_text.encode()).hexdigest() if w == "ids_sha256"
                            else hashlib.sha256(decoded.encode()).hexdigest() if w == "decoded_sha256"
                            else (int(ends[-1]) if len(ids) else 0) if w == "covered_bytes"
                            else ids if w == "ids" else starts if w == "starts" else ends if w == "ends"
                            else decoded)
                kept = batch.slice(part.start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(i) for i in range(len(names))]
                    + [pa.array(made[w], ARROW[KINDS[w]]) for w in want], names + want)

    return text_batches(given).mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keys)))


ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of a list of ids."""
    return model(path or default_path()).library.decode(ids)
