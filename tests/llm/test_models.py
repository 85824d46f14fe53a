"""Quality and toxicity on held-out rows of the smallest tables, and on odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(np.argsort(s))
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("query, label, threshold, sf, least", [(queries.op2_quality, "quality", 0.5, "0.01", 0.9), (queries.op4_toxicity, "toxic", 0.3, "0.1", 0.93)])
def test_held_out_accuracy(spark, query, label, threshold, sf, least):
    folder = f"/root/testdata/sf{sf}"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    got = query(spark, folder).toPandas()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count() and got.held_out.notna().all()
    rows = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    y, s = rows.y.to_numpy(), rows.score.to_numpy()
    assert rows.score.between(0, 1).all() and auc(y, s) > least
    hit = s >= threshold
    assert (rows.predicted == hit).all() and hit[y == 1].mean() > 0.8 and y[hit].mean() > 0.8


def test_languages_of_held_out_rows(spark):
    got = queries.op8_language_id(spark, SF).toPandas()
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    rows = got[got.held_out].merge(langs.dropna(), on="doc_id")
    assert (rows.lang_pred == rows.lang).mean() > 0.98 and rows.score.between(0, 1).all()


def odd_tables(spark):
    texts = [None, "", "!!!", "good words " * 5, "good words " * 5, "trash idiot " * 5, "w" * 200_000, "trash scum loser of you"]
    docs = spark.createDataFrame([(i, t, "9") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (5, 0, 1), (5, 0, 1), (6, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_on_odd_tables(spark):
    docs, labels = odd_tables(spark)
    for use in (labels, labels.limit(0), labels.filter("quality = 1")):
        vectors, net = quality.train(spark, docs, use)
        got = {r["doc_id"]: r["score"] for r in quality.score(spark, docs, vectors, net).collect()}
        assert len(got) == 8 and all(0 <= s <= 1 for s in got.values()) and got[3] == got[4] and got[0] == got[1]
    assert quality.score(spark, docs.limit(0), vectors, net).collect() == []
    vectors, net = quality.train(spark, docs.limit(0), labels)
    assert not vectors.any()


def test_toxicity_on_odd_tables(spark):
    docs, labels = odd_tables(spark)
    for use in (labels, labels.limit(0)):
        model = toxicity.train(spark, docs, use)
        got = {r["doc_id"]: r["score"] for r in toxicity.score(spark, docs, model).collect()}
        assert len(got) == 8 and all(0 <= s <= 1 for s in got.values()) and got[3] == got[4] and got[0] == got[1]
        assert got[5] > got[3]


def test_label_model_finds_accuracies_and_echoes():
    r = np.random.default_rng(4)
    y = r.random(20_000) < 0.3
    votes = np.zeros(len(y), np.int64)
    for v, (hit, miss) in {0: (0.9, 0.02), 2: (0.8, 0.05), 3: (0.7, 0.05)}.items():
        votes |= np.where(y, r.random(len(y)) < hit, r.random(len(y)) < miss).astype(np.int64) << v
    votes |= ((votes >> 3) & 1) << 4  # an echo of voter 3
    patterns, counts = np.unique(votes, return_counts=True)
    model = toxicity.fit_label_model(patterns, counts)
    assert abs(model.prior - 0.3) < 0.03
    assert 3 in (model.parent[4], *np.flatnonzero(model.parent == 4))
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.93


def test_features_are_counted_alike_in_sample_and_scan():
    texts = ["Trash and trash", None, "réeuxment der"]
    packed, words = toxicity._pack(texts)
    assert words.tolist() == [3, 0, 2]
    assert [len(b) // 8 for b in packed][1] == 0


def test_sign_patterns_are_learned(spark):
    r = np.random.default_rng(8)
    texts = [" ".join(["".join(r.choice(list("abcdefghij"), 6)) for _ in range(30)] + ["i*d*i*o*t"] * (i % 2)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(spark, docs, labels)
    assert model.vote_weights[toxicity.MASKED] > 0.1
    signs = 1 << toxicity.SHOUTING | 1 << toxicity.MASKED | 1 << toxicity.EXCLAIMING
    odd = ["quiet words here", "quiet w*o*rds here", None, "QUIET WORDS!!!!"]
    expected = [0, 1 << toxicity.MASKED, 0, 1 << toxicity.SHOUTING | 1 << toxicity.EXCLAIMING]
    assert (toxicity.look(odd, model.lexicons).votes & signs).tolist() == toxicity.sign_votes(odd).tolist() == expected
