"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard.

Equal vectors of a label are one class.  The classes of a label are dealt out to
shards; each shard's graph is built once and written.  Every shard is searched
with the vectors of every shard of its label: a beam of graph neighbours widens
for a query while all of it is near enough to link, and for all queries while an
audit against brute force misses its recall.  What the beams find is verified by
the cosine in double precision.

A shard pair gives back, for each vector, how many others it links, and a
spanning forest of the links; components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegauge.llm.common import components, written

SIMILARITY = 0.93
#: Vector classes of one graph; a label with more has more graphs of about this size.
SHARD = 16_384
#: Neighbours of a node (twice as many on the ground layer), beam while building, first beam of a search.
LINKS, BUILD_BEAM, BEAM = 12, 48, 48
#: Every so-manieth query of a shard pair is audited; its links must be found to this share.
AUDITED, RECALL = 16, 0.99
#: Queries searched side by side, which bounds memory.
TOGETHER = 512


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)


def _beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries side by side: (similarities, nodes), -1 where a beam is not full."""
    q, n, at_once = len(queries), len(x), max(4, width // 12)  # nodes opened for each query in a step
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    ids = np.full((q, width), n)
    sims = np.full((q, width), -np.inf, np.float32)
    k = min(width, entry.shape[1])
    entry = np.sort(entry, axis=1)
    start = np.einsum("qd,qkd->qk", queries, x[entry]).astype(np.float32)
    seen[rows, entry] = True
    again = entry[:, 1:] == entry[:, :-1]  # a node enters a beam once
    start[:, 1:][again] = -np.inf
    entry[:, 1:][again] = n
    sims[:, :k], ids[:, :k] = _top(start, entry, k)
    opened = ids == n
    live = np.arange(q)
    while len(live):
        own = np.where(opened[live], -np.inf, sims[live])
        best = np.argpartition(-own, min(at_once, width) - 1, axis=1)[:, :at_once]
        usable = np.isfinite(np.take_along_axis(own, best, 1))
        more = usable.any(axis=1)
        live, best, usable = live[more], best[more], usable[more]
        if not len(live):
            break
        side = live[:, None]
        opened[side, best] |= usable
        nodes = np.where(usable, ids[side, best], n)
        near = np.where(nodes[:, :, None] < n, links[np.minimum(nodes, n - 1)], n).reshape(len(live), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[side, near]] = n
        seen[side, near] = True
        got = np.einsum("qd,qkd->qk", queries[live], x[np.minimum(near, n - 1)])
        got[near == n] = -np.inf
        all_sims = np.concatenate([sims[live], got.astype(np.float32)], axis=1)
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_open = np.concatenate([opened[live], near == n], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        sims[live] = np.take_along_axis(all_sims, order, 1)
        ids[live] = np.take_along_axis(all_ids, order, 1)
        opened[live] = np.take_along_axis(all_open, order, 1)
    return sims, np.where(ids == n, -1, ids)


def _chosen(x: np.ndarray, nodes: np.ndarray, sims: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Of each node's candidates, best first, those nearer to it than to any chosen before; then the best of the rest."""
    ids = np.where((ids == nodes[:, None]) | ~np.isfinite(sims), -1, ids)
    near = x[np.maximum(ids, 0)]
    between = near @ near.transpose(0, 2, 1)
    kept = np.zeros(ids.shape, bool)
    closest = np.full(ids.shape, -np.inf)
    for k in range(ids.shape[1]):
        take = (ids[:, k] >= 0) & (sims[:, k] > closest[:, k]) & (kept.sum(axis=1) < count)
        kept[:, k] = take
        closest = np.where(take[:, None], np.maximum(closest, between[:, k]), closest)
    order = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :count]
    return np.take_along_axis(ids, order, 1)


class Layers:
    """The graph of one shard: per layer its nodes and their links, the top layer first."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.layers = x, layers

    @staticmethod
    def build(x: np.ndarray) -> Layers:
        """Nodes go in by growing batches; a node's layer is drawn by its position, so that builds agree."""
        height = np.floor(-np.log(np.maximum(np.random.RandomState(42).random_sample(len(x)), 1e-12)) / np.log(LINKS)).astype(int)
        out = []
        for layer in range(int(height.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(height >= layer)
            out.append((nodes, Layers._layer(x[nodes], 2 * LINKS if layer == 0 else LINKS)))
        return Layers(x, out)

    @staticmethod
    def _layer(x: np.ndarray, most: int) -> np.ndarray:
        n = len(x)
        links = np.full((n, most), -1, np.int32)
        order = np.random.RandomState(7).permutation(n)
        place = x[order]
        done = 0
        while done < n:
            size = min(max(64, done), TOGETHER, n - done)
            new = np.arange(done, done + size)
            inner = place[new] @ place[new].T
            np.fill_diagonal(inner, -np.inf)
            sims, ids = _top(inner, np.broadcast_to(new, (size, size)), min(BUILD_BEAM, size))
            if done:
                entry = np.broadcast_to(np.linspace(0, done - 1, min(32, done)).astype(int), (size, min(32, done)))
                found, nodes = _beam(place[:done], links[:done], place[new], entry, BUILD_BEAM)
                sims, ids = _top(np.concatenate([sims, found], 1), np.concatenate([ids, nodes], 1), BUILD_BEAM)
            picked = _chosen(place, new, sims, ids, most // 2)
            links[new, : picked.shape[1]] = picked
            Layers._back(place, links, np.repeat(new, picked.shape[1]), picked.ravel())
            done += size
        named = np.full((n, most), -1, np.int32)
        named[order] = np.where(links >= 0, order[np.maximum(links, 0)], -1)
        return named

    @staticmethod
    def _back(x: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        """Add the links target -> source; a full node keeps the best of old and new."""
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(nodes), TOGETHER):
            part, c = nodes[at : at + TOGETHER], count[at : at + TOGETHER]
            extra = np.full((len(part), int(c.max())), -1)
            inside = np.arange(extra.shape[1]) < c[:, None]
            extra[inside] = source[np.repeat(first[at : at + TOGETHER], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
            ids = np.concatenate([links[part], extra], axis=1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("nd,nkd->nk", x[part], x[np.maximum(ids, 0)])
            sims, ids = _top(np.where(ids < 0, -np.inf, sims), ids, min(ids.shape[1], 4 * links.shape[1]))
            kept = _chosen(x, part, sims, ids, links.shape[1])
            links[part] = -1
            links[part[:, None], np.arange(kept.shape[1])] = kept

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        nodes, links = self.layers[0]
        k = min(64, len(nodes))
        entry = np.broadcast_to(np.linspace(0, len(nodes) - 1, k).astype(int), (len(queries), k))
        for level, (nodes, links) in enumerate(self.layers):
            ground = level == len(self.layers) - 1
            sims, found = _beam(self.x[nodes], links, queries, entry, width if ground else 8)
            if ground:
                return sims, np.where(found < 0, -1, nodes[found])
            best = np.where(found < 0, found[:, :1], found)
            below = self.layers[level + 1][0]
            entry = np.searchsorted(below, nodes[best])
        raise ValueError("a graph has a layer")

    def pack(self) -> bytes:
        out = [np.array([len(self.layers)], "<i4").tobytes()]
        for nodes, links in self.layers:
            out += [np.array([len(nodes), links.shape[1]], "<i4").tobytes(), nodes.astype("<i4").tobytes(), links.astype("<i4").tobytes()]
        return b"".join(out)

    @staticmethod
    def unpack(x: np.ndarray, data: bytes) -> Layers:
        values, at, layers = np.frombuffer(data, "<i4"), 1, []
        for _ in range(int(values[0])):
            n, most = (int(v) for v in values[at : at + 2])
            at += 2
            layers.append((values[at : at + n].astype(np.int64), values[at + n : at + n + n * most].reshape(n, most)))
            at += n + n * most
        return Layers(x, layers)


def near_pairs(graph: Layers, queries: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) with a cosine of ``similarity`` or more; rows of both sides have length one, in double precision."""
    n = len(graph.x)
    floor = similarity - 1e-5  # beams compare in single precision
    fast = queries.astype(np.float32)

    def beams(rows: np.ndarray, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a, b = [], []
        for at in range(0, len(rows), TOGETHER):
            part = rows[at : at + TOGETHER]
            if width >= n:  # as wide as the shard: brute force
                i, j = np.nonzero(fast[part] @ graph.x.T >= floor)
                a.append(part[i])
                b.append(j)
                continue
            sims, ids = graph.search(fast[part], width)
            near = (sims >= floor) & (ids >= 0)
            full = near.all(axis=1)  # there may be more: these queries go on with a wider beam
            i, j = np.nonzero(near & ~full[:, None])
            a.append(part[i])
            b.append(ids[i, j])
            if full.any():
                wider = beams(part[full], width * 8)
                a += wider[0]
                b += wider[1]
        return a, b

    width = BEAM
    audit = np.arange(0, len(queries), AUDITED)
    truth = np.concatenate([(fast[audit[at : at + TOGETHER]] @ graph.x.T >= floor).sum(axis=1) for at in range(0, len(audit), TOGETHER)])
    while True:
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in beams(np.arange(len(queries)), width))
        found = np.bincount(a, minlength=len(queries))[audit].sum()
        if found >= RECALL * truth.sum() or width >= n:
            return a, b
        width *= 2


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _verified(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (row of x, row of y) have the cosine, in double precision."""
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        p, q = x[a[at : at + (1 << 16)]], y[b[at : at + (1 << 16)]]
        dot = (p * q).sum(axis=1)
        keep[at : at + (1 << 16)] = dot / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1)) >= similarity
    return keep


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indexes of links that span the components of ``n`` nodes."""
    root = np.arange(n)
    kept = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        if i != j:
            root[max(i, j)] = min(i, j)
            kept.append(k)
    return np.array(kept, np.int64)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    similarity: float = SIMILARITY, shard: int = SHARD,
) -> DataFrame:
    """Rows (id, n_links, component_id) for each row of ``vectors``, linked within equal labels.

    A vector that is null, of length zero, or has null or non-finite components,
    and one whose label is null, links with nothing and is its own component.
    Vectors of different dimensions are never compared.  Rows with equal vectors
    link with each other; a null id never names a component that has other ids.
    """
    ids = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.coalesce(F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    ids = ids.withColumn("usable", usable)
    good = ids.where("usable").withColumn("dims", F.size("v"))
    classes = good.groupBy("label", "dims", "v").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    shards = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = classes.join(shards, ["label", "dims"]).withColumn("shard", F.pmod(F.xxhash64("cid"), F.col("shards")))
    label = vectors.schema[label_col].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        raw = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        graph = Layers.build(_unit(raw).astype(np.float32))
        first = [table.column(c)[0].as_py() for c in ("label", "dims", "shard", "shards")]
        data = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("cid", "n")] + [raw.astype("<f8").tobytes(), graph.pack()]
        kinds = [table.schema.field(c).type for c in ("label", "dims", "shard", "shards")] + [pa.binary()] * 4
        return pa.table([pa.array([v], k) for v, k in zip([*first, *data], kinds)], names=["label", "dims", "shard", "shards", "cids", "counts", "raw", "graph"])

    graphs = dealt.select("label", "dims", "shard", "shards", "cid", "n", "v").groupBy("label", "dims", "shard").applyInArrow(
        build, f"label {label}, dims int, shard long, shards long, cids binary, counts binary, raw binary, graph binary"
    )
    graphs = written(graphs, "graphs")
    # each shard's vectors go to its own graph and to those before it: a pair of shards meets once
    blocks = graphs.select(
        "label", "dims", F.col("shard").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), "shard")).alias("shard"),
        F.col("cids").alias("q_cids"), F.col("counts").alias("q_counts"), F.col("raw").alias("q_raw"),
    )
    pairs = graphs.drop("shards").join(blocks, ["label", "dims", "shard"]).select("dims", "shard", "own", "cids", "counts", "raw", "graph", "q_cids", "q_counts", "q_raw")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: E731, B023
                x, q = (np.frombuffer(get(c), "<f8").reshape(-1, get("dims")) for c in ("raw", "q_raw"))
                cids, q_cids = np.frombuffer(get("cids"), "<i8"), np.frombuffer(get("q_cids"), "<i8")
                counts, q_counts = np.frombuffer(get("counts"), "<i8"), np.frombuffer(get("q_counts"), "<i8")
                graph = Layers.unpack(_unit(x).astype(np.float32), get("graph"))
                a, b = near_pairs(graph, _unit(q), similarity)
                if get("own") == get("shard"):
                    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                    a, b = pair[:, pair[0] < pair[1]]
                keep = _verified(q, x, a, b, similarity)
                a, b = a[keep], b[keep]
                tree = _forest(len(x) + len(q), a, b if get("own") == get("shard") else b + len(q))
                links = np.bincount(a, weights=counts[b], minlength=len(q)), np.bincount(b, weights=q_counts[a], minlength=len(x))
                for own, n in ((q_cids, links[0]), (cids, links[1])):
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[some]), pa.array(n[some].astype(np.int64)), pa.nulls(len(some), pa.int64())], ["cid", "n_links", "other"]
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_cids[a[tree]]), pa.array(np.zeros(len(tree), np.int64)), pa.array(cids[b[tree]])], ["cid", "n_links", "other"]
                )

    found = written(pairs.repartition("own", "shard", F.xxhash64("q_cids")).mapInArrow(search, "cid long, n_links long, other long"), "links")
    joined = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    linked = found.groupBy("cid").agg(F.sum("n_links").alias("linked"))
    named = classes.join(linked, "cid", "left").join(joined, classes.cid == joined.node, "left").select(
        "label", "dims", "v", "first_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "cid").alias("component"),
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = written(named.join(smallest, "component").drop("component", "first_id"), "named")
    result = good.join(named, ["label", "dims", "v"]).select("id", "n_links", "component_id")
    return result.union(ids.where("not usable").select("id", F.lit(0).cast("long"), "id"))
