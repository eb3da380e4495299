"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is a row of bytes; the index has a posting list for each position
and byte value.  Fingerprints of 64 bits that differ in at most three bits agree
in at least five of eight positional bytes, so three of those lie in one half of
the fingerprint.  Posting lists are therefore intersected by threes before any
pair is looked at: 8 lists of 24 bits in place of 8 lists of 8 bits.  Inside one
such list the shared positional bytes of each pair are tallied, pairs that reach
the guaranteed minimum are kept, and their bits are counted.

A list longer than ``LONGEST_LIST`` is split exactly: the bits that the list has
not fixed are cut into blocks of which one must agree again, down to lists of
which 2^14 different fingerprints are the most there can be.

Only a spanning forest of a list's links leaves the task that holds it: as many
rows as the list has members at most, and the same connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakegauge.llm.common import components, conf_set, erased, flat_components, free_name, run_bounds, shuffles_freed, sorted_runs, written

SEED = 42
#: Lists above this length are split by further bits (exactly, at any size).
LONGEST_LIST = 20_000
#: Documents whose shingles are counted to order all shingles by rarity, and the shingles that are told from rare ones.
SAMPLE, COMMON = 20_000, 200_000
#: Pairs of a set that near_copies() verifies first; all others that may be alike are verified after.
FIRST_LOOK = 2
#: Bits that tell how many shingles two sets can share at most.
PARITIES = 1024
#: Lists before this one that a row names, so that a pair that has met in one of them is not given again.
EARLIER = 8

_ONES = np.uint64(0x0101010101010101)


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers ``h`` have each bit set, bit 0 first."""
    if len(h) < 400:
        return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    rows = np.zeros((-(-len(h) // 255), 255), np.uint64)
    rows.reshape(-1)[: len(h)] = h
    out = np.empty((8, 8), np.int64)
    for bit in range(8):  # eight byte-wide counters in each 64-bit word, which hold up to 255
        lanes = ((rows >> np.uint64(bit)) & _ONES).sum(axis=1, dtype=np.uint64)
        out[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(-1)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included; of the whole text if it has fewer."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1, out=starts[1:])
    del parts
    ends = (starts[words:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends)), np.uint64, len(ends))


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash; a bit is set if it is in over half of the shingle hashes."""
    return sign_bits(shingle_hashes(text, words))


def sign_bits(h: np.ndarray) -> int:
    """The bits that over half of the hashes ``h`` have; zero if there are none."""
    return int(np.packbits(bit_sums(h) * 2 > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows (id, fp long): the SimHash of each whole text, one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _byte_mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * p for p in positions)


def _blocks(free: int, sizes: tuple[int, ...]) -> list[int]:
    """The set bits of ``free``, cut into blocks of the given sizes."""
    bits = [b for b in range(64) if free >> b & 1]
    out, at = [], 0
    for n in sizes:
        out.append(sum(1 << b for b in bits[at : at + n]))
        at += n
    return out


def list_masks() -> list[dict[int | None, list[int]]]:
    """By level: the masks that refine each mask of the level before.

    Threes of a half; then twos of the other five bytes (three of them at most
    differ); then one of four blocks of the 24 bits left, and of the 18 left.
    """
    first = [_byte_mask(t) for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
    levels: list[dict[int | None, list[int]]] = [{None: first}]
    byte_free = lambda m: tuple(p for p in range(8) if not m >> 8 * p & 0xFF)
    full = (1 << 64) - 1
    second = {m: [m | _byte_mask(t) for t in combinations(byte_free(m), 2)] for m in first}
    third = {m: [m | b for b in _blocks(full & ~m, (6, 6, 6, 6))] for ms in second.values() for m in ms}
    fourth = {m: [m | b for b in _blocks(full & ~m, (5, 5, 4, 4))] for ms in third.values() for m in ms}
    return [*levels, second, third, fourth]


def forest(x: np.ndarray, radius: int, least: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between rows of ``x`` (n, lanes): pairs (row, root of its tree).

    A search from each root tallies the positional bytes that its frontier
    shares with the rows not reached yet, keeps pairs with ``least`` of them,
    and counts their differing bits; rows that are reached leave the search.
    """
    left = np.arange(len(x))
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = np.array([root])
        while len(frontier) and len(left):
            step = max(1, 500_000 // (len(left) * x.shape[1]))
            part, frontier = frontier[:step], frontier[step:]
            diff = x[part][:, None, :] ^ x[left][None, :, :]
            tally = (diff.view(np.uint8) == 0).sum(axis=2)
            i, j = np.nonzero(tally >= least)
            near = np.zeros(len(left), bool)
            near[j[np.bitwise_count(diff[i, j]).sum(axis=1) <= radius]] = True
            if near.any():
                found = left[near]
                out += [(int(f), int(root)) for f in found]
                frontier = np.concatenate([frontier, found])
                left = left[~near]
    return out


def _list_links(batches: Iterator[pa.RecordBatch], radius: int, least: int) -> Iterator[pa.RecordBatch]:
    """Forests of the posting lists (mask, part) of a sorted partition."""
    for table in sorted_runs(batches, ["mask", "part"]):
        fp = table.column("fp").to_numpy().view(np.uint64)
        bounds = run_bounds(table.column("mask").to_numpy(), table.column("part").to_numpy())
        starts, sizes = bounds[:-1], np.diff(bounds)
        two = starts[sizes == 2]
        diff = fp[two] ^ fp[two + 1]
        keep = (diff[:, None].view(np.uint8) == 0).sum(axis=1) >= least if len(two) else np.zeros(0, bool)
        keep &= np.bitwise_count(diff) <= radius
        a, b = [fp[two[keep] + 1]], [fp[two[keep]]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            own = fp[s : s + n]
            if links := forest(own[:, None], radius, least):
                i, j = np.array(links).T
                a.append(own[i])
                b.append(own[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])


def links(fps: DataFrame, longest: int = LONGEST_LIST) -> DataFrame:
    """Edges (a, b) that join the distinct 64-bit ``fps`` (column fp) within three bits into their components."""
    spark = fps.sparkSession
    levels = list_masks()
    postings = fps.select(F.explode(F.array(*[F.lit(_signed(m)) for m in levels[0][None]])).alias("mask"), "fp")
    found: list[DataFrame] = []
    for depth in range(len(levels)):
        postings = postings.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        hot = None
        if depth + 1 < len(levels):
            hot = written(postings.groupBy("mask", "part").count().where(F.col("count") > longest), "lists")
            if hot.isEmpty():
                hot = None
        short = postings if hot is None else postings.join(hot, ["mask", "part"], "left_anti")
        found.append(
            short.repartition("mask", "part")
            .sortWithinPartitions("mask", "part", "fp")
            .mapInArrow(lambda b: _list_links(b, radius=3, least=5), "a long, b long")
        )
        if hot is None:
            break
        finer = [(_signed(m), _signed(x)) for m, xs in levels[depth + 1].items() for x in xs]
        masks = spark.createDataFrame(finer, "mask long, finer long")
        hot = hot.select("mask", "part").join(F.broadcast(masks), "mask")  # 1,280 constant rows at most
        postings = written(
            postings.join(hot, ["mask", "part"]).select(F.col("finer").alias("mask"), "fp"), "postings"
        )
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, longest: int = LONGEST_LIST
) -> DataFrame:
    """Rows (id, fingerprint, component_id): SimHash classes of documents within three bits of each other.

    One row for each row of ``docs``.  ``fingerprint`` is 16 lower-case hex
    digits; ``component_id`` the smallest id that links reach.  Null and empty
    texts have fingerprint zero and link like any other; a text of fewer words
    than a shingle is one shingle.  Repeated rows give repeated results; a null
    id belongs to its fingerprint's class and never names it unless all are
    null.  Other columns of ``docs`` are not read.  An empty table gives no rows.
    """
    marks = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = written(marks.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    classes = components(links(first.select("fp"), longest))
    joined = first.join(classes, first.fp == classes.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    smallest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = written(joined.join(smallest, "component").select("fp", "component_id"), "named")
    return marks.join(named, "fp").select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# Near copies by similarity: fingerprints of parity bits, posting lists of rarest shingles.


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, rarest first: two sets of ``similarity`` or more share one of these, whatever their order.

    The sets share ``similarity`` times the larger one's shingles at least, so not
    all shared ones can come after the first n - ceil(similarity * n) + 1 of each
    in an order that holds for both.  ``common`` rises and has known ``counts``.
    """
    seen = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        seen = np.where(common[at] == h, counts[at], 0)
    return h[np.lexsort((h, seen))][: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1] if len(h) else h


def parities(h: np.ndarray) -> bytes:
    """For each of PARITIES classes of hashes, whether the set ``h`` has an odd number of them.

    A shingle that two sets do not share changes one bit, so of the shingles in
    one set only there are as many as differing bits, or more.
    """
    odd = np.bincount((h % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _words_of_bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, PARITIES // 64)


def may_be_alike(x: np.ndarray, y: np.ndarray, both: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of parity bits of sets with ``both`` shingles together leave room for ``similarity``; none that has it is left out."""
    most = (both - np.bitwise_count(x ^ y).sum(axis=1)) / 2
    return most >= similarity / (1 + similarity) * both - 1e-6


def crossing_pairs(
    group: np.ndarray, size: np.ndarray, rest: np.ndarray, bits: np.ndarray, block: np.ndarray, similarity: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (row, row) of a list, sorted by ``group``, of different groups that can be ``similarity`` alike.

    ``rest`` is how many of a row's ``size`` shingles are left from the list's one
    on; the first that two rows share has as many left in both as they must share.
    Of rows of two blocks only those are compared that lie in different ones.
    """
    step = max(1, 250_000 // len(group))
    two = block.min() != block.max()
    for at in range(0, len(group), step):
        end = min(at + step, len(group))
        first = int(np.searchsorted(group, group[at], side="right"))
        other = slice(first, len(group))
        need = similarity / (1 + similarity) * (size[at:end, None] + size[None, other]) - 1e-6
        open_ = (group[at:end, None] < group[None, other]) & (np.minimum(rest[at:end, None], rest[None, other]) >= need)
        if two:
            open_ &= block[at:end, None] != block[None, other]
        i, j = np.nonzero(open_)
        i, j = i + at, j + first
        for s in range(0, len(i), 20_000):
            p, q = i[s : s + 20_000], j[s : s + 20_000]
            near = may_be_alike(bits[p], bits[q], size[p] + size[q], similarity)
            if near.any():
                yield p[near], q[near]


def nearest_pairs(
    group: np.ndarray, size: np.ndarray, rest: np.ndarray, bits: np.ndarray, block: np.ndarray, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Of ``crossing_pairs`` the nearest by bits of each group: as many pairs as the list has groups at most."""
    names, number = np.unique(group, return_inverse=True)
    least, best = np.full(len(names), np.inf), np.zeros((len(names), 2), np.int64)
    for i, j in crossing_pairs(group, size, rest, bits, block, similarity):
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) / np.maximum(size[i] + size[j], 1)
        order = np.lexsort((j, i, apart))
        for end in (i, j):
            own, at = np.unique(number[end[order]], return_index=True)  # the first of each group is its nearest
            at = order[at]
            new = apart[at] < least[own]
            least[own[new]], best[own[new]] = apart[at[new]], np.stack([i[at[new]], j[at[new]]], axis=1)
    i, j = best[np.isfinite(least)].T
    return i, j


def met_before(x: np.ndarray, y: np.ndarray, key: int) -> np.ndarray:
    """For each two rows of list ``key``, whether both name one earlier list; ``key`` itself fills up short rows."""
    return ((x[:, :, None] == y[:, None, :]) & (x != key)[:, :, None]).any(axis=(1, 2))


def _filled(lists: pa.ChunkedArray, fill: np.ndarray) -> np.ndarray:
    """Lists of up to EARLIER numbers as rows of a matrix, the rest of each row its ``fill``."""
    lists = lists.combine_chunks()
    out = np.repeat(fill[:, None], EARLIER, axis=1)
    out[np.arange(EARLIER) < lists.value_lengths().to_numpy()[:, None]] = lists.flatten().to_numpy()
    return out


def simhash_pairs(marks: DataFrame, longest: int = LONGEST_LIST) -> DataFrame:
    """Written pairs (a, b): each node of the rows (node, fp) with the smallest node of its SimHash class, within three bits by links."""
    marks = written(marks, "fingerprints", free=True)
    first = written(marks.groupBy("fp").agg(F.min("node").alias("one")), "classes", free=True)
    classes = flat_components(links(first.select("fp"), longest)).toDF("fp", "component")
    grouped = first.join(classes, "fp", "left").select("fp", "one", F.coalesce("component", "fp").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("one").alias("a"))
    named = written(grouped.join(smallest, "component").select("fp", "a"), "named", free=True)
    pairs = written(marks.join(named, "fp").select("a", F.col("node").alias("b")).where("a <> b"), "pairs", free=True)
    erased(marks, first, classes, named)
    return pairs


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8,
    longest: int = LONGEST_LIST,
) -> DataFrame:
    """Rows (id, row_hash, node, component): classes of texts whose word shingles are ``similarity`` alike.

    Every pair of a Jaccard similarity of ``similarity`` or more is in one class,
    and all links are verified by the shingle sets.

    The SimHash fingerprints go through the index of :func:`links`, and each
    document of a SimHash class is paired with the class's first.  For what three
    bits of 64 cannot express there is a second index, with a posting list for
    each of a set's rarest shingles, of which two sets that alike share one; its
    fingerprint is ``PARITIES`` bits, of which a pair can differ in no more than
    the shingles that it does not share.  Every row of a list is paired with the
    list's first, and each set's nearest of these by bits are verified with the
    pairs of SimHash, so that large families are one class already.  Of the lists
    that still hold several classes, each class's nearest pair by bits is verified
    next, as many as a list has classes at most, and again as long as two classes
    become one: a round at least halves those that have an alike nearest.  Then all
    pairs of a list that are still in different classes
    are taken, where sizes, places and parity bits, tested inside the list, allow
    the similarity; lists longer than ``longest`` are cut into blocks, and each
    pair of blocks is a list of its own.  A pair is judged in the first list that
    the two share, in the order of rarity; later lists pass over it where a row's
    last ``EARLIER`` lists show that it is not the first.

    ``row_hash``, of the text, tells the rows of one id apart; ``node`` is a
    64-bit hash of the shingle set.  Null and empty texts are one class.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text")
    )

    def hashes(texts: pa.Array) -> list[np.ndarray]:
        return [shingle_hashes(t.as_py(), words) for t in texts.cast(pa.binary())]

    def shingles(texts: pa.Array) -> list[np.ndarray]:
        return [np.unique(h) for h in hashes(texts)]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingles(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])

    every = max(1, -(-rows.count() // SAMPLE))
    some = rows.where(F.pmod("row_hash", F.lit(every)) == 0).dropDuplicates(["row_hash"]).select("text")
    with shuffles_freed(spark):
        often = some.mapInArrow(sampled, "h long").groupBy("h").count().where("count > 1")
        often = sorted((h & (1 << 64) - 1, n) for h, n in often.orderBy(F.desc("count"), "h").limit(COMMON).collect())
    common, counts = np.array([h for h, _ in often], np.uint64), np.array([n for _, n in often], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                whole = hashes(part.column("text"))
                sets = [np.unique(h) for h in whole]
                nodes = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
                # copies are told once a task what their set is
                new = [not (n in seen or seen.add(n)) for n in nodes.tolist()]
                if len(seen) > COMMON:
                    seen.clear()
                bits = [parities(h) if k else None for h, k in zip(sets, new)]
                fps = np.array([sign_bits(h) if k else 0 for h, k in zip(whole, new)], np.uint64).view(np.int64)
                rare = [prefix(h, similarity, common, counts).view(np.int64) if k else None for h, k in zip(sets, new)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("row_hash"), pa.array(nodes), pa.array([len(h) for h in sets], pa.int64()),
                     pa.array(rare, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(fps)],
                    ["id", "row_hash", "node", "size", "rare", "bits", "fp"])
        pa.default_memory_pool().release_unused()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of lists with several sets, each with its list's first, or itself where sizes and places part the two."""
        for table in sorted_runs(batches, ["key"]):
            key, node, place = (table.column(c).to_numpy() for c in ("key", "node", "place"))
            own = run_bounds(key, node)[:-1]  # copies once
            key, node, place = key[own], node[own], place[own]
            bounds = run_bounds(key)
            sizes = np.diff(bounds)
            first = np.repeat(bounds[:-1], sizes)
            # a pair that shares this shingle first must share as many as are left of either
            both, rest = (place >> 32) + (place[first] >> 32), np.minimum(place & 0xFFFFFFFF, place[first] & 0xFFFFFFFF)
            head = np.where(rest >= similarity / (1 + similarity) * both - 1e-6, node[first], node)
            keep = np.repeat(sizes > 1, sizes)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (key, node, place, head)], ["key", "node", "place", "head"])
        pa.default_memory_pool().release_unused()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["key", "part"]):
            key, part, node, group, place, block = (table.column(c).to_numpy() for c in ("key", "part", "node", "grp", "place", "block"))
            bits, size, rest = _words_of_bits(table.column("bits")), place >> 32, place & 0xFFFFFFFF
            bounds = run_bounds(key, part)
            found = []
            for s, e in zip(bounds[:-1], bounds[1:]):
                if group[s] != group[e - 1]:
                    i, j = nearest_pairs(group[s:e], size[s:e], rest[s:e], bits[s:e], block[s:e], similarity)
                    a, b = node[s + i], node[s + j]
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in np.unique(np.concatenate(found, axis=1), axis=1)], ["a", "b"])
        pa.default_memory_pool().release_unused()

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["key", "part"]):
            key, part, node, group, place, block = (table.column(c).to_numpy() for c in ("key", "part", "node", "grp", "place", "block"))
            bits, before = _words_of_bits(table.column("bits")), _filled(table.column("before"), key)
            size, rest = place >> 32, place & 0xFFFFFFFF
            bounds = run_bounds(key, part)
            found = []
            for s, e in zip(bounds[:-1], bounds[1:]):
                if group[s] != group[e - 1]:
                    for i, j in crossing_pairs(group[s:e], size[s:e], rest[s:e], bits[s:e], block[s:e], similarity):
                        new = ~met_before(before[s + i], before[s + j], key[s])
                        a, b = node[s + i[new]], node[s + j[new]]
                        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in np.unique(np.concatenate(found, axis=1), axis=1)], ["a", "b"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _words_of_bits(batch.column("xbits")), _words_of_bits(batch.column("ybits"))
            both = batch.column("xsize").to_numpy() + batch.column("ysize").to_numpy()
            near = pa.array(may_be_alike(x, y, both, similarity))
            apart = np.bitwise_count(x ^ y).sum(axis=1) / np.maximum(both, 1)
            yield pa.RecordBatch.from_arrays([c.filter(near) for c in (batch.column("a"), batch.column("b"), pa.array(apart))], ["a", "b", "apart"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for i in range(batch.num_rows):
                pair = []
                for node, text in (("a", "x"), ("b", "y")):
                    n = batch.column(node)[i].as_py()
                    if n not in known:
                        if len(known) > 64:
                            known.clear()
                        known[n] = shingles(batch.column(text).slice(i, 1))[0]
                    pair.append(known[n])
                n = len(np.intersect1d(*pair, assume_unique=True))
                keep.append(n >= similarity * (len(pair[0]) + len(pair[1]) - n))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])
        pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    with conf_set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"):  # whole texts
        marks = written(rows.mapInArrow(run, f"id {kind}, row_hash long, node long, size long, rare array<long>, bits binary, fp long"), "marks")
    names = written(marks.select("id", "row_hash", "node"), "names")
    sizes = written(marks.where("bits is not null").select("node", "size", "bits"), "sizes")
    by_bits = simhash_pairs(marks.where("bits is not null").groupBy("node").agg(F.min("fp").alias("fp")), longest)

    def prints(pairs: DataFrame) -> DataFrame:
        """Rows (node, size, bits) of the nodes in ``pairs``, written so that their size is known."""
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        own = sizes.join(asked, "node", "left_semi")
        return written(own.dropDuplicates(["node"]), "prints", free=True)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of nodes whose sets are ``similarity`` alike, written."""
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        one = names.groupBy("node").agg(F.min(F.struct("id", "row_hash")).alias("k")).join(asked, "node", "left_semi")
        # written, so that the texts stay where they are if it is small
        one = written(one.select("node", F.col("k.id").alias("one_id"), F.col("k.row_hash").alias("one_hash")), "asked", free=True)
        texts = rows.join(one, rows.id.eqNullSafe(one.one_id) & (rows.row_hash == one.one_hash)).select("node", "text")
        texts = written(texts.dropDuplicates(["node"]), "texts", free=True)
        both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
        with conf_set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "256"):  # two whole texts a row
            found = written(both.mapInArrow(alike, "a long, b long"), "links", free=True)
        erased(one, texts)
        return found

    postings = marks.where("rare is not null").select("node", "size", F.posexplode("rare").alias("pos", "key"))
    postings = postings.select("key", "node", (F.shiftleft("size", 32) + F.col("size") - F.col("pos")).alias("place"))
    lists = postings.repartition("key").sortWithinPartitions("key", "node").mapInArrow(shared, "key long, node long, place long, head long")
    lists = written(lists, "lists", free=True)
    erased(marks)
    pairs = written(lists.where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs", free=True)
    own = prints(pairs)
    pairs_with = pairs.join(own.toDF("b", "ysize", "ybits"), "b").join(own.toDF("a", "xsize", "xbits"), "a")
    likely = written(pairs_with.mapInArrow(possible, "a long, b long, apart double"), "possible", free=True)
    # a node's nearest by bits: what is not linked by these is found below
    first = W.partitionBy("b").orderBy("apart", "a")
    near = likely.withColumn("n", F.row_number().over(first)).where(F.col("n") <= FIRST_LOOK).select("a", "b")
    near = written(near.union(by_bits).distinct(), "nearest", free=True)
    erased(own, pairs, likely, by_bits)
    classes = flat_components(verified(near))
    erased(near)

    # what the first look left in different classes
    placed = lists.select("key", "node", "place").join(classes, "node", "left")
    placed = written(placed.select("key", "node", "place", F.coalesce("component", "node").alias("grp")), "placed", free=True)
    erased(lists)

    def mixed(placed: DataFrame) -> DataFrame:
        """The rows of lists with several classes, and ``n``, how many rows a list has; written in place of ``placed``."""
        several = placed.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
        left = written(placed.join(several.select("key", "n"), "key"), "left", free=True)
        erased(placed)
        return left

    def dealt(left: DataFrame, *more: str) -> DataFrame:
        """The rows with their bits, sorted by list, or by pair of blocks of a list."""
        cuts = F.ceil(F.col("n") / longest)
        blocked = left.join(own.select("node", "bits"), "node").withColumn("block", F.pmod(F.xxhash64("node"), cuts))
        blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
        blocked = blocked.withColumn("part", F.least("block", "other") * cuts + F.greatest("block", "other"))
        blocked = blocked.select("key", "part", "node", "grp", "place", "block", "bits", *more)
        return blocked.repartition("key", "part").sortWithinPartitions("key", "part", "grp", "node")

    def wider(pairs: DataFrame) -> DataFrame:
        """Written rows (grp, wider): the classes that those of the pairs that are alike join, with their new names."""
        group = lambda end: F.coalesce(f"{end}_group", end).alias(end)
        linked = verified(pairs).join(classes.toDF("a", "a_group"), "a", "left").join(classes.toDF("b", "b_group"), "b", "left")
        return flat_components(linked.select(group("a"), group("b"))).toDF("grp", "wider")

    def joined(names: DataFrame) -> DataFrame:
        """The classes, written again, under the names that they have joined."""
        old = classes.join(names, classes.component == names.grp, "left").select("node", F.coalesce("wider", "component").alias("component"))
        alone = names.join(classes.select("node"), names.grp == classes.node, "left_anti")
        found = written(old.union(alone), "classes", free=True)
        erased(classes)
        return found

    left = mixed(placed)
    own = prints(left.select(F.col("node").alias("a"), F.col("node").alias("b")))
    while True:  # each class's nearest, a list at a time, while these join classes
        near = written(dealt(left).mapInArrow(nearest, "a long, b long").distinct(), "nearest", free=True)
        names_now = wider(near)
        none = names_now.isEmpty()
        erased(near)
        if none:
            break
        classes = joined(names_now)
        renamed = left.drop("n").join(names_now, "grp", "left").select("key", "node", "place", F.coalesce("wider", "grp").alias("grp"))
        renamed = written(renamed, "placed", free=True)
        erased(left, names_now)
        left = mixed(renamed)
    earlier = W.partitionBy("node").orderBy(F.desc("place")).rowsBetween(-EARLIER, -1)  # rarest first
    before = left.withColumn("before", F.collect_list("key").over(earlier))
    more = written(dealt(before, "before").mapInArrow(crossing, "a long, b long").distinct(), "crossing", free=True)
    erased(left, own, sizes)
    if not more.isEmpty():  # links of the classes that there are
        classes = joined(wider(more))
    erased(more)
    return names.join(classes, "node", "left").select("id", "row_hash", "node", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, with one of each near-copy class left: that with the smallest id.

    Ids that are null come last; of rows with one id the smaller hash of the text
    stays, of rows with the same id and text any one.
    """
    marks = near_copies(docs, id_col, text_col, **options)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row_hash")
    kept = marks.groupBy("component").agg(F.min(order).alias("k"))
    kept = kept.select(F.col("k.id").alias("_kept_id"), F.col("k.row_hash").alias("_kept_hash"))
    copies = marks.groupBy("id", "row_hash").count().where("count > 1")
    kept = written(
        kept.join(copies, F.col("_kept_id").eqNullSafe(F.col("id")) & (F.col("_kept_hash") == F.col("row_hash")), "left")
        .select("_kept_id", "_kept_hash", F.col("count").isNotNull().alias("_repeated")), "kept", free=True)
    mark = free_name(docs, "_row_hash")
    hashed = docs.withColumn(mark, F.xxhash64(text_col))

    def of(repeated: bool) -> DataFrame:
        own = kept.where(F.col("_repeated") == repeated)
        same = hashed[id_col].eqNullSafe(own["_kept_id"]) & (hashed[mark] == own["_kept_hash"])
        return hashed.join(own, same, "left_semi")

    whole = of(False)
    if not kept.where("_repeated").isEmpty():
        whole = whole.union(of(True).dropDuplicates([id_col, mark]))
    return whole.drop(mark)
