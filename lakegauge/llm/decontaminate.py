"""Benchmark decontamination by a distributed positional inverted index.

The index is sharded by document: a shard is a batch of documents, and holds for
each of its terms the sorted positions where the term stands.  Shards are rows
of a written table, so a second question does not tokenise the corpus again.  A
test window is a phrase; its terms are counted over all shards, and each shard
intersects their posting lists from the rarest term on, each list moved back by
its term's offset in the phrase.

Words of an item and of a document are runs of digits, letters and characters
beyond ASCII, after lower-casing A-Z.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegauge.llm.common import erased, free_name, written

WINDOW = 13
#: A shard takes documents until their texts reach so many bytes; one longer text is a shard of its own.
SHARD_BYTES = 2 << 20

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers by byte plane, which compresses well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _shard(ids: list, texts: list[bytes | None]) -> dict:
    """One shard's postings: terms in sorted order, their counts, and their positions as differences."""
    own: dict[bytes, int] = {}
    lengths = np.zeros(len(texts), np.int64)
    parts = []
    for i, text in enumerate(texts):
        words = words_of(text)
        lengths[i] = len(words)
        for w in words:
            if w not in own:
                own[w] = len(own)
        parts.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
    terms = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    order = np.argsort(terms, kind="stable")
    counts = np.bincount(terms, minlength=len(own))
    steps = np.diff(order, prepend=0)
    starts = np.cumsum(counts) - counts
    if len(order):
        steps[starts] = order[starts]
    return {"ids": ids, "lengths": lengths, "terms": b"\n".join(own), "counts": _planes(counts), "positions": _planes(steps)}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index: a row per shard with ids, lengths, terms, counts and positions.

    Every row of ``docs`` is a document of its own, whatever its id; null and
    empty texts have no words.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes | None] = []
        size = 0

        def out() -> pa.RecordBatch:
            row = _shard(ids, texts)
            arrays = [pa.array([row["ids"]], pa.list_(id_type)), pa.array([row["lengths"]], pa.list_(pa.int64()))]
            arrays += [pa.array([row[k]], pa.binary()) for k in ("terms", "counts", "positions")]
            return pa.RecordBatch.from_arrays(arrays, list(row))

        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                ids.append(key.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or b"")
                if size >= shard_bytes:
                    yield out()
                    ids, texts, size = [], [], 0
        if ids:
            yield out()

    return written(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            run, f"ids array<{kind}>, lengths array<long>, terms binary, counts binary, positions binary"
        ),
        "postings",
    )


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """Rows (phrase array<binary>, items array<string>): distinct windows with the items that hold them, as text.

    An item of fewer words than ``width``, but not none, is one window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases, items = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                for at in range(max(1, len(words) - width + 1) if words else 0):
                    phrases.append(b"\n".join(words[at : at + width]))
                    items.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array(items, pa.string())], ["phrase", "item"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "phrase binary, item string").groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Phrases:
    """A bounded block of test windows, ready to be looked up in any shard."""

    def __init__(self, rows: list[tuple[bytes, list[str]]], frequency: dict[bytes, int]):
        split = [r[0].split(b"\n") for r in rows]
        self.items = [r[1] for r in rows]
        self.size = np.array([len(p) for p in split], np.int64)
        self.terms = sorted({w for p in split for w in p})
        number = {w: i for i, w in enumerate(self.terms)}
        width = int(self.size.max()) if rows else 0
        self.order = np.full((len(rows), width), -1, np.int64)  # offsets, the rarest term's first
        self.term = np.full((len(rows), width), -1, np.int64)
        for i, p in enumerate(split):
            rare = sorted(range(len(p)), key=lambda k: (frequency.get(p[k], 0), k))
            self.order[i, : len(p)] = rare
            self.term[i, : len(p)] = [number[p[k]] for k in rare]

    def find(self, terms: list[bytes], counts: np.ndarray, positions: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence in a shard; ``ends`` are its documents' last positions + 1."""
        number = {w: i for i, w in enumerate(terms)}
        own = np.array([number.get(w, -1) for w in self.terms], np.int64)
        none = np.zeros(0, np.int64)
        if not len(own) or not len(positions):
            return none, none
        begin = np.cumsum(counts) - counts
        there = np.where(self.term >= 0, own[self.term], 0)
        live = np.flatnonzero((there >= 0).all(axis=1))  # all terms of the window stand in this shard
        if not len(live):
            return none, none
        at = np.empty(len(positions), np.int64)  # the postings turned round: the term at each position
        at[positions] = np.repeat(np.arange(len(counts)), counts)
        first = there[live, 0]
        n = counts[first]
        window = np.repeat(live, n)
        within = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        start = positions[np.repeat(begin[first], n) + within] - self.order[window, 0]
        stop = ends[np.searchsorted(ends, start + self.order[window, 0], side="right")]
        opened = np.concatenate([[0], ends])[np.searchsorted(ends, start + self.order[window, 0], side="right")]
        fits = (start >= opened) & (start + self.size[window] <= stop)
        window, start = window[fits], start[fits]
        for k in range(1, self.order.shape[1]):  # the next rarest term's list, moved back by its offset
            if not len(window):
                break
            asked = self.order[window, k]
            same = (asked < 0) | (at[np.where(asked < 0, 0, start + asked)] == there[window, k])
            window, start = window[same], start[same]
        return window, start


    def near(
        self, terms: list[bytes], counts: np.ndarray, positions: np.ndarray, ends: np.ndarray, reach: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first, last position) where every term of a window stands within ``reach`` words of its rarest one.

        In any order, in one document; a term that a window repeats counts once.
        """
        number = {w: i for i, w in enumerate(terms)}
        own = np.array([number.get(w, -1) for w in self.terms], np.int64)
        none = np.zeros(0, np.int64)
        if not len(own) or not len(positions):
            return none, none, none
        begin = np.cumsum(counts) - counts
        there = np.where(self.term >= 0, own[self.term], 0)
        live = np.flatnonzero((there >= 0).all(axis=1))
        n = counts[there[live, 0]] if len(live) else none
        window = np.repeat(live, n)
        at = positions[np.repeat(begin[there[live, 0]], n) + np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)] if len(live) else none
        doc = np.searchsorted(ends, at, side="right")
        opened, closed = np.concatenate([[0], ends])[doc], ends[doc]
        length = int(ends[-1])
        keys = np.repeat(np.arange(len(counts)), counts) * length + positions  # rises: by term, then by position
        low, high = at.copy(), at.copy()
        for k in range(1, self.order.shape[1]):
            asked = self.term[window, k] >= 0
            wanted = there[window, k] * length + at
            after = np.searchsorted(keys, wanted)
            gap = np.full(len(window), reach + 1)
            place = at.copy()
            for side in (np.minimum(after, len(keys) - 1), np.maximum(after - 1, 0)):
                p = keys[side] - there[window, k] * length
                fits = (p >= opened) & (p < closed) & (abs(p - at) < gap)
                gap[fits], place[fits] = abs(p - at)[fits], p[fits]
            keep = ~asked | (gap <= reach)
            place = np.where(asked, place, at)
            low, high = np.minimum(low, place), np.maximum(high, place)
            window, at, low, high, opened, closed = (v[keep] for v in (window, at, low, high, opened, closed))
        return window, low, high


#: Windows in a block that goes to all tasks at once; more windows are more blocks, each a pass over the index.
BLOCK = 200_000


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    block: int = BLOCK,
    reach: int | None = None,
) -> DataFrame:
    """Rows (shard, slot, id, n_words, n_hit, items array<string>, spans array<struct<start, stop>>) for each row of ``docs``.

    A document word inside any occurrence of a window is hit; ``spans`` are the
    merged runs of hit words, ``items`` the sorted ids of items with an occurring
    window.  With ``reach``, ``near_items`` are the items that have a window whose
    terms all stand within so many words of its rarest one (else it is empty).  Test windows are read in blocks of ``block`` (a bounded table), the
    index in shards.  Null texts have no words; without test words nothing is
    hit; repeated rows give repeated results.
    """
    index = build_index(docs, id_col, text_col)
    phrases = written(windows(benchmark, item_col, item_text_col, width), "windows")
    total = phrases.count()
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = max(1, -(-total // block))
    found: DataFrame | None = None
    for k in range(blocks):
        own = phrases if blocks == 1 else phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k)
        part = _hits(index, [(bytes(r[0]), list(r[1])) for r in own.collect()], kind, reach)
        found = part if found is None else found.union(part)
    if blocks == 1:
        return found
    merged = found.groupBy("shard", "slot").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    joined = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<start:long,stop:long>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1),
                     F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    merged = merged.withColumn("spans", joined).withColumn("items", F.sort_array(F.array_distinct("items")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return merged.select("shard", "slot", "id", "n_words", hit.alias("n_hit"), "items", "spans", "near_items")


def _hits(index: DataFrame, rows: list[tuple[bytes, list[str]]], kind: str, reach: int | None) -> DataFrame:
    wanted = sorted({w for r in rows for w in r[0].split(b"\n")})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        want = set(wanted)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w, n in zip(terms.split(b"\n"), _from_planes(counts).tolist()):
                    if w in want:
                        sums[w] = sums.get(w, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["term", "n"])

    # a row per test term at most reaches the driver, as the test windows do
    counted = index.select("terms", "counts").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = {bytes(r[0]): r[1] for r in counted.collect()} if rows else {}
    phrases = Phrases(rows, frequency)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids = one.column("ids").flatten()
                lengths = one.column("lengths").flatten().to_numpy()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                counts = _from_planes(one.column("counts")[0].as_py()).astype(np.int64)
                positions = _from_planes(one.column("positions")[0].as_py()).astype(np.int64)
                if len(positions):  # differences start anew with each term
                    starts = np.cumsum(counts) - counts
                    summed = np.cumsum(positions)
                    positions = summed - np.repeat(summed[starts] - positions[starts], counts)
                terms = one.column("terms")[0].as_py()
                terms = terms.split(b"\n") if len(counts) else []
                window, start = phrases.find(terms, counts, positions, ends)
                close: list[set[str]] = [set() for _ in range(len(lengths))]
                if reach is not None:
                    beside, first, _ = phrases.near(terms, counts, positions, ends, reach)
                    for d, w in set(zip(np.searchsorted(ends, first, side="right").tolist(), beside.tolist())):
                        close[d].update(phrases.items[w])
                marks = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
                np.add.at(marks, start, 1)
                np.add.at(marks, start + phrases.size[window], -1)
                hit = np.cumsum(marks)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                doc = np.searchsorted(ends, start, side="right")
                items: list[set[str]] = [set() for _ in range(len(lengths))]
                for d, w in set(zip(doc.tolist(), window.tolist())):
                    items[d].update(phrases.items[w])
                spans: list[list[dict]] = []
                for d in range(len(lengths)):
                    if items[d]:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[begins[d] : ends[d]].view(np.int8), [0]])))
                        spans.append([{"start": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)])
                    else:
                        spans.append([])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([one.column("shard")[0].as_py()] * len(lengths), pa.int64()),
                        pa.array(np.arange(len(lengths))),
                        ids,
                        pa.array(lengths),
                        pa.array(total[ends] - total[begins]),
                        pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                        pa.array([sorted(s) for s in close], pa.list_(pa.string())),
                    ],
                    ["shard", "slot", "id", "n_words", "n_hit", "items", "spans", "near_items"],
                )

    numbered = index.select(F.monotonically_increasing_id().alias("shard"), "*")
    return numbered.mapInArrow(
        look,
        f"shard long, slot long, id {kind}, n_words long, n_hit long, items array<string>, "
        "spans array<struct<start:long,stop:long>>, near_items array<string>",
    )


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated: fewer than a twentieth of their words are hit.

    A row is told by id and text: rows that agree in both have one verdict.  The
    index is deleted once the verdicts are written.
    """
    key = free_name(docs, "_row_hash")
    hashed = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")))
    found = contamination(hashed, benchmark, id_col=key, text_col=text_col, **options)
    bad = written(found.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select("id.id", "id.h").distinct(), "bad", free=True)
    erased(found)  # the index that it is read from
    same = docs[id_col].eqNullSafe(bad["id"]) & (F.xxhash64(docs[text_col]) == bad["h"])
    return docs.join(bad, same, "left_anti")
