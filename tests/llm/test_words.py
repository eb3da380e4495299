"""SentencePiece coding, collocations and importance resampling."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lakegauge.llm import importance, phrases, pieces
from lakegauge.llm.common import read
from lakegauge.llm.queries import PIECE_MODEL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))


@pytest.fixture(scope="module")
def coder():
    return pieces.vocabulary(tokenizer_path(PIECE_MODEL))


def odd_texts(coder):
    rnd = random.Random(5)
    kinds = ["ab cd▁  eé\n\t🦄  ", "▁ ", "the in er on", "".join(map(chr, range(0x250))), "".join(rnd.sample(coder.texts, 300))]
    texts = ["", " ", "  a  b ", "▁x▁▁", "<s>hi</s>", "<0x0A>", "a\x00b", "ﬁ ①  ", "a" * 5000, " " * 3000, "é" * 2000, "x y" * 9000]
    for k in range(3000):
        if k % 3:
            texts.append("".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(0, 40))))
        else:  # pieces glued at random: borders that other merges would cross
            texts.append("".join(rnd.choice(coder.texts) for _ in range(rnd.randint(0, 8))))
    return texts


def test_pieces_as_the_library(coder, library):
    for text in odd_texts(coder):
        ids = library.encode(text)
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids, text
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(coder, library):
    rnd = random.Random(6)
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(300), 259, 28705]) for _ in range(rnd.randint(0, 6))]
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_unfit_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x12\x02\x18\x01")  # a model of another kind
    with pytest.raises(ValueError, match="not supported"):
        pieces.Vocabulary(str(tmp_path / "m"))


def test_encoded_rows(spark, library):
    texts = [None, "", "same", "same", "a  b", "word " * 30_000]
    docs = spark.createDataFrame([(None if i == 1 else i // 2, t, b"x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids binary, decoded string")
    found = pieces.encoded(docs, tokenizer_path(PIECE_MODEL))
    assert found.columns == ["id", "ids", "decoded"]
    got = sorted((str(r["id"]), tuple(r.list), r.n, r.decoded) for r in found.select("*", pieces.id_list(F.col("ids")).alias("list"), pieces.n_ids(F.col("ids")).alias("n")).collect())
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((str(None if i == 1 else i // 2), tuple(ids), len(ids), library.decode(ids)))
    assert got == sorted(want)
    bare = pieces.encoded(docs, tokenizer_path(PIECE_MODEL), ends=False)
    assert bare.where(F.octet_length("ids") == 0).count() == 2
    back = pieces.decoded(bare, tokenizer_path(PIECE_MODEL))
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for t in texts)
    assert pieces.encoded(docs.limit(0), tokenizer_path(PIECE_MODEL)).count() == 0
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_sentencepiece_query(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_sentencepiece"](spark, SF).collect()}
    docs = read(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        hashes = [hashlib.sha256(b).hexdigest() for b in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode())]
        assert got[r.doc_id] == (len(ids), *hashes)


def plain_collocations(rows, longest=4, least=30, covered=80, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, own in counts.items():
        able = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in able.items():
            longer = [f for q, f in able.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * f >= covered * a for f in longer):
                continue
            score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrase_rows():
    rnd = random.Random(8)
    rows = [("en", None), (None, ""), (None, "Ä b. Ä b"), ("xx", "..."), ("en", "a a a a a a a a")]
    for i in range(400):
        parts = [rnd.choice(["New York City", "new york", "of the", "red", "É é", "the end of", "don't", "w%d" % rnd.randrange(40)]) for _ in range(rnd.randint(0, 30))]
        rows.append((rnd.choice(["en", "en", "de", None]), "".join(p + rnd.choice([" ", "\t", "  ", ", ", "\n", "? "]) for p in parts)))
    return rows + [("en", "hot line here")] * 200 + [("de", " ".join(["lang"] * 20000))]


@pytest.mark.parametrize(("least", "shards", "bits"), [(30, phrases.SHARDS, phrases.FILTER_BITS), (5, 3, 1 << 15), (2, 4, 1 << 20)])
def test_collocations(spark, least, shards, bits):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, text string, n int, phrase string").repartition(9)
    frequent = phrases.frequent_phrases(docs, least=least, shards=shards, filter_bits=bits)
    got = phrases.collocations(frequent, top=50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, least=least, top=50)


def test_longer_and_shorter_phrases(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    for longest in (2, 3, 5):
        got = phrases.collocations(phrases.frequent_phrases(docs, longest=longest, least=10))
        assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, longest, 10)
    assert phrases.collocations(phrases.frequent_phrases(docs.limit(0))).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**18
    frequent = spark.createDataFrame([("a", "x y", 2, big), ("a", "x", 1, big), ("a", "y", 1, big + 7), ("a", "", 0, big)], "lang string, phrase string, size int, n long")
    assert [r.score for r in phrases.collocations(frequent).collect()] == [2000000 * big // (2 * big + 7)]


def plain_resampling(rows, items, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in features(x)) for texts in ([r[1] for r in rows], items))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for key, text in rows:
        own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    able = sorted((-r[3], r[0] is None, r[0] or 0, r[1], r[2], i) for i, r in enumerate(out) if r[4] >= least)
    ranks = {r[-1]: k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(map(str, ([*r[:4], ranks.get(i)] for i, r in enumerate(out))))


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 50, 60), (2, 1000, 100)])
def test_resampling(spark, longest, buckets, percent):
    rnd = random.Random(9)
    vocabulary = ["Alpha", "beta", "x1", "ÉTÉ", "été", "日本", "nine", "ten"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", "-", "\n", "_", "\x7f"]) for _ in range(n))
    rows = [(i, text(rnd.randint(0, 60))) for i in range(300)] + [(None, text(30)), (7, None), (8, ""), (9, "... !"), (10, text(20_000))]
    rows += [rows[3]] * 40 + [(None, text(25))]
    items = [text(40) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(*r, 5, "s") for r in rows], "doc_id long, text string, score int, bucket string")
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = importance.resampled(docs, target, longest=longest, buckets=buckets, percent=percent)
    got = sorted(str([r["id"], r.n_features, r.weight, r.score, r["rank"]]) for r in got.collect())
    assert got == plain_resampling(rows, items, longest, buckets, percent=percent)


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = docs.limit(0)
    assert importance.resampled(none, docs).count() == 0
    assert {r["rank"] for r in importance.resampled(docs, none).collect()} == {None}
    assert {r["rank"] for r in importance.resampled(docs, docs).collect()} == {None}
