"""Collocations: phrases of words that stand together more often than their parts suggest.

Frequent phrases are found by partitioning.  The tasks' texts are dealt to a few
shards, each of which is mined completely at the support lowered in proportion:
a phrase with ``least`` occurrences in all has ``least / shards`` of them in some
shard.  A shard is no task's load: its counts are summed by phrase like any
others.  Shards are mined by rising length, single words, pairs, then two
lengths at a time, and a phrase is counted only where the shorter ones inside it
were found.  What any shard finds is put together and counted exactly over all
texts.

In the mining, phrases are 64-bit hashes, and what was found travels as a
filter of a fixed number of bits.  Equal hashes and a full filter only let more
phrases through to the exact count, which is over the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakegauge.llm.common import shuffles_freed, written

LONGEST = 4
LEAST = 30
TOP = 2000
#: A longer candidate with so many hundredths of a phrase's occurrences covers it.
COVERED = 80
SHARDS = 4
#: Bits of the filter of phrases found; 8 MB.
FILTER_BITS = 1 << 26
#: Texts are taken together up to so many bytes.
BLOCK_BYTES = 8 << 20
#: Parts that more than one in so many links name are joined by broadcast: at most so many parts.
HOT_SHARE = 500
NO_LANG = "und"

#: Bytes that end a piece become full stops, A-Z lower case; all others stay.
_TABLE = bytes(0x2E if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256)).lower()
_BITS_OF_BUCKET = 32768  # what a bitmap of Spark's bitmap_construct_agg holds


def pieces_and_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09]+`` in order, with ``b"."`` between pieces; no word holds a full stop."""
    return text.translate(_TABLE).replace(b".", b" . ").split()


class _Block:
    """Words of texts of one language, as numbers of their dictionary; number 0 is the border between pieces."""

    def __init__(self, lang: str, words: list[bytes]):
        coded = pa.array([b".", *words], pa.binary()).dictionary_encode()
        self.numbers = coded.indices.to_numpy()
        self.words = coded.dictionary.to_pylist()
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.n = int(np.count_nonzero(self.numbers))

    def phrases(self, found: list[Filter | None], sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, starts, hashes) of the phrases of each size up to the last, of which all shorter ones are ``found``.

        ``found[k]`` tells of phrases of k + 1 words; those of ``sizes`` are given out, after their own filter if there is one.
        """
        hashes = self.hashes[self.numbers]
        now, ok = hashes, self.numbers > 0
        for size in range(1, sizes.stop):
            if size > 1:
                ok = ok[:-1] & ok[1:]
                now = _mixed(now[:-1], hashes[size - 1 :])
            if size - 1 < len(found) and found[size - 1] is not None:
                ok = ok.copy()
                at = np.flatnonzero(ok)
                ok[at] = found[size - 1].has(now[at])
            if size in sizes:
                at = np.flatnonzero(ok)
                yield size, at, now[at]


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase and the next word; the order of the words counts."""
    h = left * np.uint64(0x9E3779B97F4A7C15) + right
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    return hashes % np.uint64(bits), (hashes >> np.uint64(32)) % np.uint64(bits)


class Filter:
    """Set of hashes in a fixed number of bits; may also say yes to others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        a, b = _places(hashes, len(self.bits) * 8)
        bit = lambda p: self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & np.uint8(1)
        return (bit(a) & bit(b)).astype(bool)


def _filter(found: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes of the ``h`` of ``found``, made of bitmaps joined in Spark; at most ``bits / 8`` bytes reach the driver."""
    numbers = F.array(F.pmod(F.col("h"), F.lit(bits)), F.pmod(F.shiftright("h", 32), F.lit(bits)))
    rows = found.select(F.explode(numbers).alias("p"))
    maps = rows.groupBy(F.floor(F.col("p") / _BITS_OF_BUCKET).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("p"), F.lit(_BITS_OF_BUCKET))).alias("bits")
    )
    out = np.zeros(bits // 8, np.uint8)
    with shuffles_freed(found.sparkSession):
        rows = maps.select("*").collect()
    for row in rows:
        one = np.frombuffer(bytes(row.bits), np.uint8)
        out[row.bucket * (_BITS_OF_BUCKET // 8) :][: len(one)] = one
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Block]]:
    """A task's texts by language, in blocks of some megabytes."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def out() -> Iterator[tuple[str, _Block]]:
        for lang, own in held.items():
            yield lang, _Block(lang, pieces_and_words(b".".join(own)))
        held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                held.setdefault(lang, []).append(text)
                size += len(text) + 1
                if size >= BLOCK_BYTES:
                    yield from out()
                    size = 0
    yield from out()


def _filters(shared: list[tuple[range, Broadcast]]) -> list[Filter]:
    """The filter of each size that was mined, the size of one word first."""
    return [one for sizes, b in shared for one in [Filter(b.value)] * len(sizes)]


def _mined(rows: DataFrame, sizes: range, shared: list[tuple[range, Broadcast]], least: int, shards: int) -> DataFrame:
    """Rows (h): phrases of ``sizes`` words that have the lowered support in some shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        found = _filters(shared)
        for _, block in _blocks(batches):
            for _, _, hashes in block.phrases(found, sizes):
                values, counts = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), shard, np.int32)), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))],
                    ["shard", "h", "n"],
                )

    counted = rows.mapInArrow(run, "shard int, h long, n long").groupBy("shard", "h").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= -(-least // shards)).select("h")


def _counted(rows: DataFrame, longest: int, shared: list[tuple[range, Broadcast]]) -> DataFrame:
    """Rows (lang, phrase, size, n) over all texts: what the filters let through; size 0 counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _filters(shared)
        for lang, block in _blocks(batches):
            phrases, sizes, counts = [b""], [0], [block.n]
            for size, starts, hashes in block.phrases(found, range(1, longest + 1)):
                # equal hashes are told apart by their words
                codes = np.stack([block.numbers[starts + k] for k in range(size)], axis=1) if len(starts) else np.zeros((0, size), np.int32)
                order = np.lexsort((*codes.T, hashes))
                codes = codes[order]
                change = np.ones(len(order), bool)
                change[1:] = (codes[1:] != codes[:-1]).any(axis=1)
                first = np.flatnonzero(change)
                phrases += [b" ".join([block.words[i] for i in row]) for row in codes[first].tolist()]
                counts += np.diff(np.append(first, len(order))).tolist()
                sizes += [size] * len(first)
            values = [pa.array([lang] * len(sizes), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(values, ["lang", "phrase", "size", "n"])

    counted = rows.mapInArrow(run, "lang string, phrase string, size int, n long")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
    shards: int = SHARDS, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Rows (lang, phrase, size, n): phrases of 1 to ``longest`` words with ``least`` occurrences or more, by language.

    A row of size 0, with an empty phrase, counts all words of its language.
    Occurrences lie within a piece and may overlap.  A null language is
    ``und``, a null text is empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    shared: list[tuple[range, Broadcast]] = []
    for first in [1, *range(2, longest + 1)[:1], *range(3, longest + 1, 2)]:
        sizes = range(first, min(first + (2 if first > 2 else 1), longest + 1))
        found = _mined(rows, sizes, shared, least, shards)
        shared.append((sizes, spark.sparkContext.broadcast(_filter(found, filter_bits))))
    counted = _counted(rows, longest, shared)
    found = written(counted.where((F.col("n") >= least) | (F.col("size") == 0)), "phrases", free=True)
    for _, one in shared:
        one.unpersist()
    return found


def _part(first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.col("words"), first, count), " ")


def _with_counts(parts: DataFrame, known: DataFrame) -> DataFrame:
    """``parts`` with the count ``m`` of each ``part`` in its language.

    Parts that very many phrases share, of which there can be at most
    ``2 * HOT_SHARE``, are joined by broadcast, so that none fills one task.
    """
    known = known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("m"))
    links = parts.groupBy("lang", "part").agg(F.count("*").alias("links"))
    all_links = parts.agg(F.count("*")).first()[0]
    hot = written(links.where(F.col("links") * HOT_SHARE > F.lit(all_links)).join(known, ["lang", "part"]).select("lang", "part", "m"), "hot")
    often = parts.join(F.broadcast(hot), ["lang", "part"])
    rare = parts.join(F.broadcast(hot.select("lang", "part")), ["lang", "part"], "left_anti").join(known, ["lang", "part"])
    return often.unionByName(rare)


def collocations(frequent: DataFrame, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of ``frequent_phrases``.

    Of a phrase's cuts into two parts with l and r occurrences, the one with the
    lowest floor(2000000 * a / (l + r)) counts, the first among equals.  Phrases
    inside a longer one with ``covered`` hundredths of their occurrences are left
    out.  Order: score and a descending, then the phrase's bytes.
    """
    phrases = frequent.where("size >= 2").withColumn("words", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "size", "n", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), _part(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")),
    )
    parts = written(cuts.select("lang", "phrase", F.col("n").alias("a"), "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.*"), "parts")
    cut = _with_counts(parts, frequent.where("size >= 1")).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("m"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("m"))).alias("r")
    )
    score = F.expr("2000000 * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + r)")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    # phrases inside longer ones: the largest count of a longer one, gathered in each task first
    inside = phrases.where("size >= 3").select("lang", "n", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part_size"))
    inside = inside.select("lang", "n", "words", "part_size", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part_size") + 1)).alias("at"))
    longer = inside.select("lang", _part(F.col("at"), F.col("part_size")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(19, 0)") < covered * F.col("a").cast("decimal(19, 0)"))
    )
    order = W.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = frequent.where("size = 0").select("lang", F.col("n").alias("words_of_lang"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", F.col("words_of_lang").alias("n"),
        F.col("b.score").cast("long").alias("score"),
    )
