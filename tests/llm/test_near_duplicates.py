"""SimHash and embedding near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakegauge.llm import simhash, vectors
from lakegauge.llm.common import components, flat_components

DOCS = "doc_id long, text string"


def plain_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_texts(seed, count):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(count):
        if texts and rnd.random() < 0.6:
            words = rnd.choice(texts).split()
            for _ in range(rnd.choice([0, 1, 1, 2])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        else:
            words = [rnd.choice(vocabulary) for _ in range(rnd.choice([30, 200, 600]))]
        texts.append(" ".join(words))
    return texts


def test_fingerprint_is_the_plain_one():
    for text in [None, "", " \n", "One", "a b", "a b c", "A B C d e f", "é ü ñ x y", *near_texts(1, 12)]:
        assert simhash.fingerprint(text.encode() if text else text) == plain_fingerprint(text, 3)
    long = " ".join(f"w{i % 977}" for i in range(5000))
    assert simhash.fingerprint(long.encode()) == plain_fingerprint(long, 3)


@pytest.mark.parametrize("longest", [20_000, 2])
def test_classes_are_those_of_all_pairs(spark, longest):
    texts = near_texts(2, 90) + [None, "", "one two", "ONE  two"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS).withColumn("fp", F.lit(1)).withColumn("id", F.lit(2))
    found = {r["id"]: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, longest=longest).collect()}
    fps = [plain_fingerprint(t, 3) for t in texts]
    want = classes(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert found == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}


def test_lists_are_refined_exactly():
    """Any two numbers within three bits agree on some mask of every level's tree."""
    rnd = random.Random(3)
    levels = simhash.list_masks()
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.choice([1, 2, 3])):
            b ^= 1 << bit
        shared = [m for m in levels[0][None] if a & m == b & m]
        assert shared
        for level in levels[1:]:
            shared = [f for m in shared for f in level[m] if a & f == b & f]
            assert shared
    assert all(64 - f.bit_count() <= 14 for fs in levels[-1].values() for f in fs)


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(5, "x y z"), (5, "x y z"), (None, "x y z"), (None, "q r s t"), (1, "")], DOCS)
    found = sorted((str(r["id"]), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert found == [("1", "1"), ("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_class_of_copies_stays(spark):
    rnd = random.Random(4)
    base = [" ".join(f"t{rnd.randrange(4000)}" for _ in range(400)) for _ in range(12)]
    rows = []
    for i, text in enumerate(base):
        words = text.split()
        rows.append((10 * i, text, "kept"))
        rows.append((10 * i + 1, text, "copy"))
        for k in range(3):  # three changed words in 400: about 0.93 of the shingles of five are shared
            w = list(words)
            for at in rnd.sample(range(400), 3):
                w[at] = "changed"
            rows.append((10 * i + 2 + k, " ".join(w), "near"))
        half = words[:200] + [f"u{rnd.randrange(4000)}" for _ in range(200)]
        rows.append((10 * i + 9, " ".join(half), "kept"))
    rows += [(1000, None, "kept"), (1001, "", "copy"), (1002, "a b", "kept"), (1002, "a b", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_hash string")
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    got = sorted((r.doc_id, r.row_hash) for r in left.collect())
    assert got == sorted({(i, k) for i, _, k in rows if k == "kept"})


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_flat_components(spark):
    rnd = random.Random(12)
    far = list(range(300, 380))
    rnd.shuffle(far)
    edges = [(i, i + 1) for i in range(40)] + [(i, 100) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)] + list(zip(far, far[1:]))
    got = {r.node: r.component for r in flat_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200} | {i: 300 for i in far}
    assert flat_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_rows(seed):
    rnd = np.random.RandomState(seed)
    out, centres = [], rnd.normal(size=(12, 16))
    for i in range(400):
        v = centres[rnd.randint(12)] + rnd.normal(size=16) * rnd.choice([0.05, 0.3, 2.0])
        out.append((i, v.astype(np.float32).tolist(), int(rnd.randint(2))))
    out += [(1000 + i, out[i][1], out[i][2]) for i in range(20)]
    out += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1)]
    out += [(2004, [float("inf")] * 16, 0), (2005, out[0][1], None), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0)]
    return out


@pytest.mark.parametrize("shard", [16_384, 60])
def test_vectors_link_as_in_brute_force(spark, shard):
    rows = vector_rows(5)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("x"))
    ok = [v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) and lab is not None for _, v, lab in rows]

    def linked(i, j):
        if not (ok[i] and ok[j]) or rows[i][2] != rows[j][2] or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93

    n = len(rows)
    degree = [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)]
    root = classes(n, linked)
    got = {r["id"]: (r.n_links, r.component_id) for r in vectors.near_duplicates(table, shard=shard).collect()}
    assert got == {rows[i][0]: (degree[i], rows[root[i]][0]) for i in range(n)}
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_graph_search_recall():
    rnd = np.random.RandomState(6)
    x = vectors._unit(np.repeat(rnd.normal(size=(700, 24)), 4, axis=0) + rnd.normal(size=(2800, 24)) * 0.08)
    graph = vectors.Layers.build(x.astype(np.float32))
    again = vectors.Layers.unpack(graph.x, graph.pack())
    a, b = vectors.near_pairs(again, x, 0.93)
    truth = (x @ x.T >= 0.93).sum()
    assert vectors._verified(x, x, a, b, 0.93).sum() >= 0.95 * truth


@pytest.mark.parametrize("longest", [simhash.LONGEST_LIST, 7])
def test_near_copies_find_every_pair_of_the_similarity_asked_for(spark, longest):
    """Short texts at just 0.8, and a family whose nearest rows by bits are not the alike ones."""
    rnd = random.Random(11)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in (8, 14, 18, 28, 60) * 12:  # the last words of the longer text are the fifth that is not shared
        w = new(n + (n - 4) // 4)
        texts += [" ".join(w[:n]), " ".join(w)]
    common = new(300)
    for i in range(40):  # 0.74 to 0.8 alike
        texts.append(" ".join(common + new(45)))
    texts += [None, "", "a b", "A  b"]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    want = classes(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["id"]: r.component for r in simhash.near_copies(docs, longest=longest).collect()}
    first = {}
    for i in range(len(texts)):
        first.setdefault(got[i], i)
    assert [first[got[i]] for i in range(len(texts))] == [want[i] for i in range(len(texts))]


def test_near_copies_go_through_the_simhash_index(spark, monkeypatch):
    """Texts within three bits are paired with their class's first, by the index of op1; what is less alike stays."""
    rnd = random.Random(5)
    texts = []
    for _ in range(6):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
        texts += [" ".join(w), " ".join([*w[:-1], "other"]), " ".join(w[:1500] + w)]
    texts += [None, "", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    fps = np.array([simhash.fingerprint((t or "").encode(), 5) for t in texts], np.uint64)
    want = classes(len(texts), lambda i, j: (int(fps[i]) ^ int(fps[j])).bit_count() <= 3)
    marks = spark.createDataFrame(list(zip(range(len(texts)), fps.view(np.int64).tolist())), "node long, fp long")
    got = {(r.a, r.b) for r in simhash.simhash_pairs(marks).collect()}
    assert len(got) >= 6 and got == {(want[i], i) for i in range(len(texts)) if want[i] != i}
    asked, index = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, longest: asked.append(fps.columns) or index(fps, longest))
    left = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    assert asked == [["fp"]]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    alike = classes(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert left == sorted(set(alike))


def test_families_that_the_first_look_leaves_join_by_few_links(spark, monkeypatch):
    """A family that comes apart in the first look is joined by links as many as its rows, not their square."""
    rnd = random.Random(3)
    common = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(common + [f"x{i}y{k}" for k in range(5)]) for i in range(60)] + [" ".join(common[200:]), "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    monkeypatch.setattr(simhash, "FIRST_LOOK", 0)
    monkeypatch.setattr(simhash, "simhash_pairs", lambda marks, longest: spark.createDataFrame([], "a long, b long"))
    counts, join = [], simhash.flat_components

    def counted(edges):
        counts.append(edges.count())
        return join(edges)

    monkeypatch.setattr(simhash, "flat_components", counted)
    got = {r["id"]: r.component for r in simhash.near_copies(docs).collect()}
    assert len({got[i] for i in range(60)}) == 1 and len(set(got.values())) == 3
    assert max(counts) <= 2 * len(texts)


def test_pairs_of_a_list_that_met_in_an_earlier_one_are_told():
    key = 7
    x = np.array([[1, 2, key, key], [1, 2, key, key], [key] * 4], np.int64)
    y = np.array([[9, 2, 3, key], [5, 6, 7, key], [key] * 4], np.int64)
    assert simhash.met_before(x, y, key).tolist() == [True, False, False]
