from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import language, quality, queries
from emberline.llm.common import is_held_out

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_rows(spark):
    got = queries.op1_language(spark, SF).join(queries.table(spark, SF, "documents"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_languages_of_odd_rows(spark, odd):
    train = queries.table(spark, SF, "documents")
    model = language.fit(train, queries.learnable)
    got = {r["doc_id"]: r for r in language.predict(odd, model, [F.col("doc_id")]).where("doc_id is not null").collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["score"] == 0
    assert got[7]["lang_pred"] in model.languages and got[7]["rejected"]
    assert language.predict(odd.where(F.lit(False)), model, [F.col("doc_id")]).count() == 0
    blank = language.identify(odd.withColumn("lang", F.lit(None).cast("string")), queries.learnable, is_held_out())
    assert {r["lang_pred"] for r in blank.collect()} == {"und"}


def test_clusters_have_length_one_and_are_repeatable():
    x = np.abs(np.random.default_rng(0).normal(size=(50, 8))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = language.cluster(x, 3)
    assert c.shape == (3, 8) and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5) and (c == language.cluster(x, 3)).all()
    assert len(language.cluster(np.repeat(x[:1], 5, axis=0), 3)) == 1


def test_quality_of_held_out_rows(spark):
    got = queries.op7_quality(spark, SF).join(queries.table(spark, SF, "labels"), "doc_id").where("held_out")
    n, good = got.count(), got.where("quality = 1")
    assert got.where("predicted = quality").count() >= 0.95 * n
    assert good.where("predicted = 1").count() >= 0.97 * good.count()


@pytest.fixture(scope="module")
def net():
    texts = [b"the quiet river runs along the old wall. " * 9, b"zz## qq## zz## " * 20] * 12
    return quality.train(texts, np.array([1.0, 0.0] * 12), rounds=4)


def test_the_whole_document_counts(net):
    tables = net.pairs()
    long = b"the quiet river runs along the old wall. " * 500
    p, many = quality.pooled([long, b""], net, tables)
    assert many.tolist() == [len(quality.chunk_starts(len(quality.padded(long)))), 1]
    starts = quality.chunk_starts(len(quality.padded(long)))
    assert starts[-1] + quality.CHUNK >= len(quality.padded(long)) and max(np.diff(starts)) < quality.CHUNK
    changed = long[:-600] + b"zz## qq## zz## " * 40
    assert quality.scores([changed], net, tables)[0] < quality.scores([long], net, tables)[0]


def test_pooling_equals_the_plain_network(net):
    text = b"some words, some more words! " * 23
    x = np.frombuffer(quality.padded(text) + bytes(quality.WIDTH), np.uint8)
    n = len(quality.padded(text))
    raw = np.array([sum(net.filters[k][x[i + k]] for k in range(quality.WIDTH)) for i in range(n)])
    want = [np.maximum(raw[s : min(s + quality.CHUNK, n)].max(axis=0) + net.bias, 0) for s in quality.chunk_starts(n)]
    got, _ = quality.pooled([b"other", text], net, net.pairs())
    assert np.allclose(got[1:], want, atol=1e-4)


def test_quality_of_odd_rows(odd, net):
    got = quality.score_rows(odd, net, [F.col("doc_id")]).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert {r["score"] for r in quality.score_rows(odd, None, [F.col("doc_id")]).collect()} == {0.5}
    assert quality.score_rows(odd.where(F.lit(False)), net, [F.col("doc_id")]).count() == 0


LABELS = "doc_id long, quality int, toxic int"


def test_quality_without_labels_and_with_odd_labels(spark, odd, docs):
    none = spark.createDataFrame([], LABELS)
    got = quality.quality(odd, none, queries.learnable, is_held_out()).collect()
    assert len(got) == 10 and {(r["score"], r["predicted"]) for r in got} == {(0.5, 1)}
    assert quality.drop_rejected(odd, none, queries.learnable).count() == 10
    blank = spark.createDataFrame([(None, 1, 0), (5, None, 0), (99, 1, 1)], LABELS)
    assert quality.fit(odd, blank, queries.learnable) is None
    clash = spark.createDataFrame([(5, 0, 0), (5, 1, 0), (6, 0, 0), (7, 0, 1), (8, 1, 1)], LABELS)
    a, b = (quality.quality(odd, clash, lambda c: F.lit(True), is_held_out()).collect() for _ in range(2))
    assert sorted(map(str, a)) == sorted(map(str, b)) and len({r["score"] for r in a if r["doc_id"] == 5}) == 1
    assert quality.drop_rejected(odd, clash, lambda c: F.lit(True)).columns == odd.columns


def test_long_documents_take_part_in_training(docs, spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.append((texts, labels)))
    rows = docs((1, "a" * 300_000 + "z" * 300_000), (2, "short"), *[(3, "copy")] * 50, (4, "bad"))
    quality.fit(rows, spark.createDataFrame([(i, int(i < 4), 0) for i in range(1, 5)], LABELS), lambda c: F.lit(True), per_label=3)
    (texts, labels), = seen
    assert len(texts) == 4 and labels.tolist() == [1, 1, 1, 0]
    assert len(texts[0]) == 64 * quality.CHUNK and texts[0][:1] == b"a" and texts[0][-1:] == b"z" and 0.4 < texts[0].count(b"a") / len(texts[0]) < 0.6


def test_threshold_keeps_good_texts_of_the_half_not_trained_on(spark):
    docs, marks = queries.table(spark, "/root/testdata/sf0.001", "documents"), queries.table(spark, "/root/testdata/sf0.001", "labels")
    texts, y = quality.sample(docs, marks, lambda c: F.lit(True))
    net = quality.train(texts[::2], y[::2])
    good = [quality.scores([t], net, net.pairs())[0] for t, label in zip(texts[1::2], y[1::2], strict=True) if label == 1]
    for lose in (0.0, 0.1, 0.5):
        least = quality.least_score(texts, y, lose, floor=0.0)
        assert sum(s < least for s in good) <= lose * len(good) and least <= 0.5
        assert least == 0.5 or sum(s <= least for s in good) > lose * len(good)
    assert quality.least_score(texts, y, floor=0.5) == 0.5
    assert quality.least_score([], np.zeros(0)) == quality.least_score(texts, np.ones(len(texts))) == 0.5


def slow_cosines(text: str, model: language.Model) -> list[float]:
    """By dictionaries: letters folded, n-grams of 1 to 3 bytes counted, weighted, and compared with each centroid."""
    folded = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode())
    squeezed = re.sub(b" +", b" ", b" " + folded + b" ")
    tf: dict[int, int] = {}
    for n in (1, 2, 3):
        for i in range(len(squeezed) - n + 1):
            k = ((int.from_bytes(squeezed[i : i + n], "big") + n) * 2654435761 % 2**32) >> 20
            tf[k] = tf.get(k, 0) + 1
    x = {k: float(np.log1p(v) * model.idf[k]) for k, v in tf.items()}
    size = sum(v * v for v in x.values()) ** 0.5
    return [sum(v * float(c[k]) for k, v in x.items()) / size for c in model.centroids]


def test_predictions_against_brute_force(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    model = language.fit(docs, queries.learnable, per_language=20)
    got = {r["doc_id"]: r for r in language.predict(docs, model, [F.col("doc_id")]).collect()}
    for r in docs.where("length(text) < 1500").limit(25).collect():
        near = slow_cosines(r["text"], model)
        assert got[r["doc_id"]]["score"] == pytest.approx(max(near), abs=1e-3)
        best = {model.languages[model.owners[i]] for i, v in enumerate(near) if v > max(near) - 1e-3}
        assert got[r["doc_id"]]["lang_pred"] in best


def test_languages_with_many_copies_ties_and_rejection(spark, docs):
    rows = docs(*[(i, "the same english text again") for i in range(200)], (900, "der gleiche deutsche text"), (901, "the other")).withColumn("lang", F.when(F.col("doc_id") == 900, "de").otherwise("en"))
    model = language.fit(rows, lambda c: F.lit(True), per_language=5)
    assert model.languages == ["de", "en"] and len(model.centroids) == 3
    twin = language.Model(["a", "b"], model.idf, np.repeat(model.centroids[:1], 2, axis=0), np.array([0, 1]), np.array([0.0, 0.0]))
    assert language.classify([b"der text"], twin)[0] == ["a"]
    far = docs((1, "\u6f22\u5b57"), (2, "the same english text again"))
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(far, model, [F.col("doc_id")], strict=True).collect()} == {1: "und", 2: "en"}
