"""SentencePiece encoding and decoding by a table of last pieces.

A merge-type vocabulary encodes a text by always merging the adjacent pair whose
joined piece scores best, the leftmost among equals.  A sequence of pieces is
the encoding of its text exactly if each piece encodes to itself and no merge
ever crosses a border between two neighbours.  So every prefix of a text has one
last piece: the one that ends there, and whose left neighbour, the last piece of
the prefix before it, is compatible with it.  An automaton over the vocabulary
names the pieces that end at each place, a test of pairs picks the right one,
and the ids are read off the table backwards.
"""

from __future__ import annotations

import codecs
import heapq
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the model file's format
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE_MODEL = 2
SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
# end of the fixed values

#: Stretches between spaces, and pairs of pieces, that a worker remembers; forgetting them changes no result.
KEPT = 1 << 20
#: Longer stretches are encoded anew each time.
KEPT_LENGTH = 48
#: Texts are taken together up to so many bytes.
BLOCK_BYTES = 4 << 20

_STRETCH = regex.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

#: The library gives one replacement character for each byte that is no UTF-8; the built-in handler joins them.
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


def _best_pair(symbols: list[str], scores: dict[str, float]) -> Iterator[tuple[float, int]]:
    """Merge ``symbols`` in place as the vocabulary does, yielding (score, number of the left symbol) of each merge."""
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    queue: list[tuple[float, int, int, str]] = []

    def offer(left: int, right: int) -> None:
        if left >= 0 and right < len(symbols):
            joined = symbols[left] + symbols[right]
            if joined in scores:
                heapq.heappush(queue, (-scores[joined], left, right, joined))

    for i in range(len(symbols) - 1):
        offer(i, i + 1)
    while queue:
        cost, left, right, joined = heapq.heappop(queue)
        if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != joined:
            continue
        symbols[left], symbols[right] = joined, ""
        after[left] = after[right]
        if after[right] < len(symbols):
            before[after[right]] = left
        yield -cost, left
        offer(before[left], left)
        offer(left, after[left])


class Vocabulary:
    """A merge-type model file: encodes texts to ids, decodes ids to texts.

    Texts are taken as they are, with a space put before them, and characters
    without a piece become their bytes.  Models of other kinds, normalising
    models, and pieces set by users or left unused are refused.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        rows, train, norm = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                rows.append((one[1].decode(), struct.unpack("<f", one.get(2, b"\0" * 4))[0], one.get(3, NORMAL)))
            elif number == 2:
                train = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        kinds = {kind for _, _, kind in rows}
        plain = not norm.get(2) and norm.get(3, 1) and not norm.get(4, 1) and norm.get(5, 1) and not train.get(24, 0)
        if train.get(3) != BPE_MODEL or not plain or not train.get(35) or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("this kind of model is not supported")
        self.begin, self.end = train.get(41, 1), train.get(42, 2)
        scores = {text: score for text, score, kind in rows if kind == NORMAL}
        self.scores = scores
        ids = {text: i for i, (text, _, kind) in enumerate(rows) if kind == NORMAL}
        bytes_at = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(rows) if kind == BYTE}
        self.byte_ids = [bytes_at[b] for b in range(256)]
        # characters that occur in pieces only count as pieces here; their ids are those of their bytes
        loose = sorted({c for text in ids for c in text} - set(ids))
        self.texts = [*ids, *loose]
        self.out = [struct.pack("<I", i) for i in ids.values()] + [self._bytes(c) for c in loose]
        self.alphabet = {c for text in self.texts for c in text}
        # the merges of each piece by itself: their scores, and what stands at its left and right border before each of them
        self.merges: list[tuple[list[float], list[str], list[str]] | None] = []
        automaton = ahocorasick.Automaton()
        for number, text in enumerate(self.texts):
            symbols = list(text)
            costs, lefts, rights = [], [symbols[0]], [symbols[-1]]
            for score, _ in _best_pair(symbols, scores):
                costs.append(score)
                lefts.append(symbols[0])
                rights.append(next(s for s in reversed(symbols) if s))
            whole = symbols[0] == text
            self.merges.append((costs, lefts, rights) if whole else None)
            if whole:  # others never come out of an encoding
                automaton.add_word(text, (number, len(text)))
        automaton.make_automaton()
        self.automaton = automaton
        self.pairs: dict[int, bool] = {}
        self.joins_across = any(text.lstrip(SPACE).find(SPACE) >= 0 for text in ids)
        # what an id adds to a decoded text
        self.said = [b""] * len(rows)
        for i, (text, _, kind) in enumerate(rows):
            if kind == NORMAL:
                self.said[i] = text.replace(SPACE, " ").encode()
            elif kind == BYTE:
                self.said[i] = bytes([int(text[3:5], 16)])
            elif kind == UNKNOWN:
                self.said[i] = (train[44].decode() if 44 in train else UNKNOWN_TEXT).encode()
        self.starts_with_space = {i for text, i in ids.items() if text[0] == SPACE}
        self.silent = {i for i, (_, _, kind) in enumerate(rows) if kind == CONTROL}
        self.known = _Known(self)

    def _bytes(self, text: str) -> bytes:
        return b"".join(struct.pack("<I", self.byte_ids[b]) for b in text.encode())

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces ``a`` and ``b`` side by side stay as they are.

        Their own merges run in the order of scores, the left piece's first
        among equals; the two must never have symbols at their border whose
        merge comes before the next of these.
        """
        key = a * len(self.texts) + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            found = self.pairs[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        left_scores, _, borders = self.merges[a]
        right_scores, heads, _ = self.merges[b]
        i = j = 0
        none = float("-inf")
        while True:
            left = left_scores[i] if i < len(left_scores) else none
            right = right_scores[j] if j < len(right_scores) else none
            across = self.scores.get(borders[i] + heads[j])
            if across is not None and across > left and across >= right:
                return False
            if left == none and right == none:
                return True
            if left >= right:
                i += 1
            else:
                j += 1

    def encode_stretch(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of a text with its spaces already marked."""
        n = len(text)
        last, starts = [-1] * (n + 1), [0] * (n + 1)
        outside = [i for i, c in enumerate(text) if c not in self.alphabet]
        for i in outside:
            last[i + 1], starts[i + 1] = -2, i
        for at, (piece, length) in self.automaton.iter(text):
            at += 1
            if last[at] == -1:
                start = at - length
                before = last[start]
                if start == 0 or before == -2 or (before >= 0 and self.compatible(before, piece)):
                    last[at], starts[at] = piece, start
        parts, at = [], n
        while at:
            start = starts[at]
            parts.append(self.out[last[at]] if last[at] >= 0 else self._bytes(text[start:at]))
            at = start
        parts.reverse()
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text without begin and end; the empty text has none.

        No piece has a space after another character, so stretches of spaces
        and what follows them are encoded one by one and remembered.
        """
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        if self.joins_across:
            return self.encode_stretch(marked)
        return b"".join(map(self.known.__getitem__, _STRETCH.findall(marked)))

    def decode(self, ids: bytes) -> str:
        """Text of ids: control ids say nothing, one space at the start goes, bytes that are no UTF-8 are replaced."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        said = b"".join(map(self.said.__getitem__, numbers))
        first = next((i for i in numbers if i not in self.silent), -1)
        if first in self.starts_with_space:
            said = said[1:]
        return said.decode("utf-8", "each_byte")


class _Known(dict):
    """Ids of stretches; new ones are encoded when asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, text: str) -> bytes:
        ids = self.vocabulary.encode_stretch(text)
        if len(text) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[text] = ids
        return ids


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary of a model file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True) -> DataFrame:
    """Rows (id, ids, decoded), one for each row of ``docs``, from the model file that every worker has at ``model``.

    ``ids`` are little-endian unsigned 32-bit integers in a binary value
    (``id_list`` makes an array of them), with the begin and end ids if
    ``ends``; ``decoded`` is the text that they decode to.  A null text is
    empty.  Rows keep null and repeated ids; each text is read whole, in one
    task with its neighbours and without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(model)
        first, last = (struct.pack("<I", coder.begin), struct.pack("<I", coder.end)) if ends else (b"", b"")
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                n = max(1, int(np.searchsorted(sizes[at:], done + BLOCK_BYTES)))
                ids = [first + coder.encode(t or "") + last for t in batch.column("text").slice(at, n).to_pylist()]
                texts = pa.array(map(coder.decode, ids), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, n), pa.array(ids, pa.binary()), texts], ["id", "ids", "decoded"])
                at += n

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, decoded string")


def decoded(rows: DataFrame, model: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text) of the texts that binary ``ids`` stand for; null ids give a null text."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(model)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


def n_ids(ids: Column) -> Column:
    """Number of ids in a binary value."""
    return (F.octet_length(ids) / 4).cast("long")


def id_list(ids: Column) -> Column:
    """A binary value's ids as an array of long."""
    digits = F.hex(ids)
    places = F.when(F.octet_length(ids) > 0, F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def one(place: Column) -> Column:
        pair = lambda k: F.substr(digits, place * 8 + 2 * k + 1, F.lit(2))
        return F.conv(F.concat(pair(3), pair(2), pair(1), pair(0)), 16, 10).cast("long")

    return F.transform(places, one)
