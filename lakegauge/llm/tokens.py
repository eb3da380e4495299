"""Token-ID files: one wavelet matrix for each shard of consecutive documents.

A shard's ids are cut into bit planes, the highest first.  After each plane the
sequence is divided stably by its bit, zeros before ones, so that rank and
select on the planes lead from a position to its id, from an id to the number of
its occurrences in any range, and to the place of each of them.  A shard is one
binary value: header, document ends, planes; ranks are kept for blocks of 512
bits.  A table of shards is written through Spark, whose Parquet pages compress
the planes.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakegauge.llm.common import new_path

END_ID = 2
#: A shard takes documents until it has so many ids; one longer document is a shard of its own.
SHARD_IDS = 1 << 21
#: Distinct words whose ids a worker keeps; others are looked up again, which changes no result.
KEPT_WORDS = 850_000

_HEADER = struct.Struct("<4sBQQ")  # magic, planes, ids, documents
_BLOCK = 512


class WaveletMatrix:
    """Succinct sequence of non-negative ids below 2 ** planes."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.n = n
        self.planes = planes  # packed bits, highest plane first
        self.ranks: list[np.ndarray] = []
        self.zeros: list[int] = []
        for plane in planes:
            padded = np.zeros(-(-len(plane) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
            padded[: len(plane)] = plane
            ones = np.bitwise_count(padded.view(np.uint64)).astype(np.int64).reshape(-1, _BLOCK // 64).sum(axis=1)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones)]))
            self.zeros.append(n - int(self.ranks[-1][-1]))

    @staticmethod
    def build(ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes = []
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        then = np.empty_like(now)
        for k in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << k)).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            zeros = len(now) - int(np.count_nonzero(ones))
            np.compress(ones, now, out=then[zeros:])
            np.logical_not(ones, out=ones)
            np.compress(ones, now, out=then[:zeros])
            now, then = then, now
        return WaveletMatrix(planes, len(ids))

    def rank1(self, level: int, at: int) -> int:
        """Ones of a plane before position ``at``."""
        block = at // _BLOCK
        part = self.planes[level][block * (_BLOCK // 8) : (at + 7) // 8]
        bits = np.unpackbits(part, bitorder="little")[: at - block * _BLOCK]
        return int(self.ranks[level][block]) + int(bits.sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        ranks = self.ranks[level]
        before = ranks if bit else np.arange(len(ranks)) * _BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = self.planes[level][block * (_BLOCK // 8) : (block + 1) * (_BLOCK // 8)]
        bits = np.unpackbits(part, bitorder="little")[: self.n - block * _BLOCK]
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, at: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit = self.planes[level][at // 8] >> (at % 8) & 1
            ones = self.rank1(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | int(bit)
        return value

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self.rank1(level, start), self.rank1(level, stop)
            if value >> (len(self.planes) - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of ``value`` in [start, stop)."""
        a, b = self._range(value, min(start, self.n), self.n if stop is None else min(stop, self.n))
        return b - a

    def locate(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``value``."""
        at, stop = self._range(value, 0, self.n)
        at += k
        if not 0 <= k < stop:
            raise IndexError(k)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence: the planes' divisions undone, the lowest first."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            out, zeros = np.empty(self.n, kind), self.zeros[level]
            out[np.flatnonzero(ones)] = now[zeros:] | kind(1 << (bits - 1 - level))
            np.logical_not(ones, out=ones)
            out[np.flatnonzero(ones)] = now[:zeros]
            now = out
        return now


def pack(ids: np.ndarray, ends: np.ndarray, bits: int) -> bytes:
    """A shard file: header, document ends (uint64), planes."""
    planes = WaveletMatrix.build(ids, bits).planes
    return b"".join([_HEADER.pack(b"WMX1", bits, len(ids), len(ends)), ends.astype("<u8").tobytes(), *(p.tobytes() for p in planes)])


def unpack(data: bytes) -> tuple[WaveletMatrix, np.ndarray]:
    magic, bits, n, docs = _HEADER.unpack_from(data)
    if magic != b"WMX1":
        raise ValueError("not a shard file")
    at = _HEADER.size
    ends = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
    at += 8 * docs
    size = (n + 7) // 8
    if len(data) != at + bits * size:
        raise ValueError("shard file is cut short")
    return WaveletMatrix([np.frombuffer(data, np.uint8, size, at + k * size) for k in range(bits)], n), ends


#: A space before white space, or at the end, is a case for the tokenizer's own splitting of the whole text.
_ODD_SPACE = (
    " ([\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}"
    "\\x{3000}\\x{feff}]|$)"
)


_PIECE = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\n")
_SIMPLE = regex.compile(r"[^\s]+(?:\n[^\s]+)*")


class Encoder:
    """Ids of whole texts; each distinct word between spaces goes through the tokenizer once.

    A byte-level tokenizer never joins what stands before a space with what
    follows it, when the space precedes a visible character; so the ids of such
    words, each with its space, are the ids of the text.  Texts with other
    spaces go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_level = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec.get("normalizer") is None and byte_level.get("type") == "ByteLevel" and not byte_level.get("add_prefix_space")
            and byte_level.get("use_regex", True) and (spec.get("model") or {}).get("type") == "BPE"
            and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
        )
        size = self.tokenizer.get_vocab_size()
        self.bits = max(1, int(size - 1).bit_length())
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.pieces: dict[str, list[int]] = {}
        # characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.mapped = {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, text: str) -> list[int]:
        """Ids of one piece of the byte-level splitting, from the model itself."""
        ids = self.pieces.get(text)
        if ids is None:
            ids = [t.id for t in self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(self.mapped))]
            if len(text) < 8 and len(self.pieces) < KEPT_WORDS // 4:
                self.pieces[text] = ids
        return ids

    def _pieces(self, word: str) -> list[int] | None:
        """Ids of a space and a word, or None where the splitting has more cases than letters, digits, signs and a line end."""
        if word.isalpha():
            return [t.id for t in self.tokenizer.model.tokenize("Ġ" + word.encode().decode("latin-1").translate(self.mapped))]
        if "'" in word or not _SIMPLE.fullmatch(word) or any(t in word for t in self.added):
            return None
        first, *rest = _PIECE.findall(word)
        ids = list(self._piece(" " + first))
        for piece in rest:
            ids += self._piece(piece)
        return ids

    def _learn(self, words: list[str]) -> None:
        """Add words, each to be read with the space before it."""
        stems, tails = [], []
        for w in words:  # a full stop or comma at a word's end is a token sequence of its own
            tail = w[-1] if w[-1] in ".," and w[-2:-1].isalpha() else ""
            stems.append(w[:-1] if tail else w)
            tails.append(tail)
        fresh = list(dict.fromkeys(w for w in stems if w not in self.known))
        found = [self._pieces(w) for w in fresh]
        whole = [w for w, ids in zip(fresh, found) if ids is None]
        if whole:
            own = iter(self._whole([" " + w for w in whole]))
            found = [next(own).tolist() if ids is None else ids for ids in found]
        if fresh:
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self._add(fresh, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)
        for tail in ".,":
            ended = [w for w, t in zip(words, tails) if t == tail and w not in self.known]
            if ended:
                last = self._whole([tail])[0]
                base = np.fromiter((self.known[w[:-1]] for w in ended), np.int64, len(ended))
                lengths = self.length[base] + len(last)
                stops = np.cumsum(lengths)
                joined = np.empty(int(stops[-1]), np.uint32)
                for k, i in enumerate(last):
                    joined[stops - len(last) + k] = i
                stem = self.length[base]
                within = np.arange(int(stem.sum())) - np.repeat(np.cumsum(stem) - stem, stem)
                joined[np.repeat(stops - lengths, stem) + within] = self.flat[np.repeat(self.start[base], stem) + within]
                self._add(ended, joined, lengths)

    def _add(self, words: list[str], joined: np.ndarray, lengths: np.ndarray) -> None:
        first, count = len(self.known), len(words)
        while self.used + len(joined) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + count > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + len(joined)] = joined
        self.length[first : first + count] = lengths
        self.start[first : first + count] = self.used + np.cumsum(lengths) - lengths
        self.used += len(joined)
        self.known.update(zip(words, range(first, first + count)))

    def _trim(self, first: int, used: int) -> None:
        """Forget the words added from ``first`` on."""
        for w in list(islice(reversed(self.known), len(self.known) - first)):
            del self.known[w]
        self.used = used

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); null is the empty text."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        odd = np.ones(n, bool)
        if self.by_word:
            odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        odd |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        odd |= pc.starts_with(texts, " ").to_numpy(zero_copy_only=False)
        pieces: list[np.ndarray | None] = [None] * n
        alone = np.flatnonzero(odd)
        for i, ids in zip(alone, self._whole(texts.take(pa.array(alone)).to_pylist())):
            pieces[i] = ids
        rest = np.flatnonzero(~odd)
        if len(rest):
            split = pc.split_pattern(texts.take(pa.array(rest)), " ")
            offsets = split.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            before = len(self.known), self.used
            if fresh := [w for w in words if w not in self.known]:
                self._learn(fresh)
            number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
            lengths = self.length[number]
            # the first word of a text has no space before it
            heads = offsets[:-1]
            firsts = self._whole([words[c] for c in coded.indices.to_numpy()[heads]])
            lengths[heads] = [len(f) for f in firsts]
            total = np.concatenate([[0], np.cumsum(lengths)])
            begin = self.start[number]
            begin[heads] = 0
            ids = self.flat[np.repeat(begin - total[:-1], lengths) + np.arange(total[-1])]
            edges = total[offsets]
            for i, a, b, f in zip(rest, edges[:-1], edges[1:], firsts):
                ids[a : a + len(f)] = f
                pieces[i] = ids[a:b]
            if len(self.known) > KEPT_WORDS:  # frequent words come early, so the first to come stay
                self._trim(*before)
        sizes = np.array([len(p) for p in pieces], np.int64)
        return (np.concatenate(pieces) if n else np.zeros(0, np.uint32)), sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode every text, append ``end_id``, and write shards in ascending id order to ``path``.

    Null ids come first; rows with equal ids stand in the order of their texts'
    hashes.  A null text is empty.  ``tokenizer`` is the path of a tokenizer file
    that every worker has.  Shards are rows (part, number, doc_ids, n_ids, file).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        part, number = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays(ids)
            ends = np.cumsum(np.concatenate(sizes))
            data = pack(np.concatenate(tokens), ends, coder.bits)
            one = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
            values = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), one, pa.array([int(ends[-1])]), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(values, ["part", "number", "doc_ids", "n_ids", "file"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()[at:])
                n = max(1, int(np.searchsorted(lengths, 6 << 20)))  # texts of about 6 MB at a time
                texts = batch.column("text").slice(at, n)
                found, size = coder.encode(texts)
                ended = np.full(len(found) + len(size), end_id, np.uint32)
                stops = np.cumsum(size + 1) - 1
                keep = np.ones(len(ended), bool)
                keep[stops] = False
                ended[keep] = found
                ids.append(batch.column("id").slice(at, n))
                tokens.append(ended)
                sizes.append(size + 1)
                held += len(ended)
                at += n
                if held >= shard_ids:
                    yield out()
                    ids, tokens, sizes, held, number = [], [], [], 0, number + 1
        if ids:
            yield out()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    (
        rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
        .mapInArrow(run, f"part int, number int, doc_ids array<{kind}>, n_ids long, file binary")
        .write.option("compression", "zstd").parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32, ids) in each shard's order, decoded from its wavelet matrix.

    Without ``with_ids`` the ids are decoded and summed up but not returned.

    ``start`` counts the ids of all documents before it: within a shard from its
    document ends, and before the shard from the shards' sizes, of which there is
    a row each.
    """
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    shards = files.select("part", "number", "n_ids")
    own = F.sum("n_ids").over(W.partitionBy("part").orderBy("number")) - F.col("n_ids")
    placed = shards.join(before, "part").select("part", "number", (F.col("part_start") + own).alias("shard_start"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                matrix, ends = unpack(batch.column("file")[i].as_buffer())
                ids = matrix.decode().astype("<u4")
                starts = np.concatenate([[0], ends[:-1]])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                doc_ids = batch.column("doc_ids").slice(i, 1).flatten()
                shard = [np.full(len(ends), batch.column(c)[i].as_py(), np.int32) for c in ("part", "number")]
                values = [*map(pa.array, shard), doc_ids, pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())]
                if with_ids:
                    values.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(values, ["part", "number", "id", "within", "n_tokens", "ids_crc32", "ids"][: len(values)])

    decoded = files.select("part", "number", "doc_ids", "file").mapInArrow(
        run, f"part int, number int, id {kind}, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    )
    return decoded.join(placed, ["part", "number"]).select(
        "id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def token_files(docs: DataFrame, tokenizer: str, with_ids: bool = True, **options) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back; an empty table gives no rows."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(docs.sparkSession, path, with_ids)
