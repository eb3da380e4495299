"""Language, quality and toxicity: held-out accuracy on the given tables, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakegauge.llm import language, quality, toxicity
from lakegauge.llm.common import crc_bucket, read
from lakegauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        code = language.codebook(n)
        distance = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(distance) >= max(1, code.shape[1] // 4)
        assert all(0 < (column > 0).sum() < n for column in code.T)


def test_language_of_held_out_texts(spark):
    truth = read(spark, SF, "documents").select("doc_id", "lang")
    rows = QUERIES["op3_language_id"](spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog were there", "en"), (2, "der Hund und die Katze waren da", "de"), (3, "unlabelled", None), (4, None, "fr")],
        "doc_id long, text string, lang string",
    )
    model = language.train(docs)
    assert model.languages == ("de", "en")
    asked = spark.createDataFrame([(None,), ("",), ("123 -- 45",), ("and the dog was there",), ("der Hund und da " * 300_000,)], "text string")
    found = [r.f.lang_pred for r in asked.select(language.identify(spark, model, F.col("text")).alias("f")).collect()]
    assert found == ["und", "und", "und", "en", "de"]
    nothing = language.train(docs.limit(0))
    assert nothing.predict("some text") == ("und", 0.0, False)
    assert asked.limit(0).select(language.identify(spark, nothing, F.col("text")).alias("f")).count() == 0


def test_grams_do_not_depend_on_parts(monkeypatch):
    text = ("abc déf ghi " * 50).encode()
    whole = np.concatenate(list(language.grams(text)))
    monkeypatch.setattr(language, "PART_BYTES", 7)
    assert np.array_equal(np.concatenate(list(language.grams(text))), whole)


def test_quality_of_held_out_texts(spark):
    labels = read(spark, SF, "labels")
    rows = QUERIES["op2_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert QUERIES["op2_quality_classifier"](spark, SF).where("score is null or score < 0 or score > 1").count() == 0


def test_trees_walk_as_one_by_one():
    rnd = np.random.RandomState(0)
    x = rnd.normal(size=(500, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.2) ^ (x[:, 5] < -0.1)).astype(float)
    model = quality.fit(x, y, trees=30)

    def one(row):
        total = model.start
        for node in model.roots:
            while model.children[node, 0] != node:
                node = model.children[node, int(row[model.feature[node]] > model.threshold[node])]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    scores = model.score(x)
    assert np.allclose(scores, [one(r) for r in x])
    assert np.mean((scores > 0.5) == y) > 0.95


def test_quality_edges():
    assert quality.statistics(None) == quality.statistics(b"") == [0.0] * len(quality.FEATURES)
    for text in (b" ", b"\n\n", b"a", "é".encode(), b"!!! !!!", b"x " * 500_000):
        assert np.isfinite(quality.statistics(text)).all()
    for y in (np.zeros(0), np.ones(5)):
        model = quality.fit(np.zeros((len(y), len(quality.FEATURES))), y)
        assert 0 < model.score(np.zeros((1, len(quality.FEATURES))))[0] < 1
    assert len(quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).score(np.zeros((0, len(quality.FEATURES))))) == 0


def toxic_rows():
    rnd = np.random.RandomState(1)
    syllables = ["re", "in", "the", "on", "an", "er", "at", "tion", "st", "ou"]
    word = lambda: "".join(rnd.choice(syllables, rnd.randint(1, 4)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for at in rnd.choice(60, 8, replace=False):
                words[at] = str(rnd.choice(["blimp", "grumpz", "vexwad"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxic_texts_are_told(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, keep=crc_bucket(F.col("id"), 5) != 0)
    assert set(model.segments) == {b"blimp", b"grumpz", b"vexwad"}
    scored = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.toxicity(spark, model, F.col("text")).alias("s")).collect()}
    assert np.mean([(scored[i] >= 0.5) == bool(y) for i, _, y in rows]) > 0.97
    edge = spark.createDataFrame([(None,), ("",), ("!!",), ("re in on " * 200_000,)], "text string")
    scores = [r.s for r in edge.select(toxicity.toxicity(spark, model, F.col("text")).alias("s")).collect()]
    assert all(0 <= s < 0.5 for s in scores) and scores[0] == scores[1] == scores[2]


def test_contexts_do_not_count_copies():
    once = toxicity.contexts([b"a b c. A b d"])
    assert toxicity.contexts([b"a b c. A b d"] * 5) == once
    assert once[b"b"] == 2 and once[b"a"] == 2
    assert toxicity.contexts([None, b"", b"..."]) == {}


def test_toxicity_without_both_kinds():
    for rows in ([], [(b"some words here", 0, 1)], [(b"some words here", 1, 2)]):
        assert 0 < toxicity.fit(rows).score([b"any", None])[0] < 1


@pytest.mark.parametrize("name", ["op2_quality_classifier", "op10_toxicity"])
def test_every_document_is_scored(spark, name):
    docs = read(spark, SF, "documents").count()
    found = QUERIES[name](spark, SF)
    assert found.count() == docs and found.where("predicted not in (0, 1)").count() == 0


def test_texts_without_a_letter_have_no_language(spark):
    model = language.train(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de")], "doc_id long, text string, lang string"))
    texts = ["½ ²", "Ⅷ", "①", "١٢", "__ 12 !", "", None, "é", "日本"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r.f.lang_pred for r in docs.select(language.identify(spark, model, F.col("text")).alias("f")).collect()]
    assert found[:7] == ["und"] * 7 and set(found[7:]) <= {"en", "de"}
