"""Toxicity and quality ranking: held-out accuracy on planted words and surface, folds, edge frames."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.llm import ranking, toxicity

from .helpers import doc_frame, edge_documents

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=800):
    rng = random.Random(4)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    bad = ["zworg", "quelpid", "vrakthul", "grumpf"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(40, 120))]
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(bad)
        if not good:
            words = [w + rng.choice(["###", "$$$", "|"]) for w in words]
        rows.append((i, " ".join(words), "en", "src0", 0))
        labels.append((i, good, toxic))
    return doc_frame(spark, rows), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (ranking, "quality")])
def test_held_out_accuracy(spark, module, label):
    docs, labels = corpus(spark)
    got = module.score(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == 800
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0.0 <= r["score"] <= 1.0
    unseen = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r[label] for r in unseen]) >= 0.95


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (ranking, "quality")])
def test_held_out_labels_are_never_read(spark, module, label):
    docs, labels = corpus(spark, 200)
    flipped = labels.withColumn(label, F.when(ranking.held_out("doc_id"), 1 - F.col(label)).otherwise(F.col(label)))
    a = {r["doc_id"]: r["score"] for r in module.score(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in module.score(docs, flipped).collect()}
    assert a == b


@pytest.mark.parametrize("module", [toxicity, ranking])
def test_edges(spark, module):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], LABELS)
    got = module.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert module.score(docs, labels.limit(0)).count() == docs.count()
    assert module.score(docs.limit(0), labels).count() == 0


def test_ranker_orders_pairs():
    """With one informative feature, its weight decides every pair."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(ranking.FEATURES)))
    y = (x[:, 2] < 0.3).astype(int)
    model = ranking.fit_ranker(x, y)
    s = model.scores(x)
    good, bad = s[y == 1], s[y == 0]
    assert np.mean(good[:, None] > bad[None, :]) > 0.97
    assert abs(np.mean(s < model.cut) - np.mean(y == 0)) < 0.02  # the quantile threshold


def test_compression_lengths_tell_the_dictionaries_apart():
    distance = toxicity.Distance(b" vrakthul quelpid zworg ", b" ordinary words stand here ")
    assert distance("vrakthul")[2] > 0 > distance("ordinary")[2]


def all_pairs_weights(model, x, y, l2=1e-3):
    """Newton steps over every pair of a good and a bad row, one by one."""
    z = model.design(x)
    diff = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-diff @ w))
        w = w - np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + l2 * np.eye(len(w)),
                                diff.T @ (p - 1) / len(diff) + l2 * w)
    return w


def test_ranker_compares_all_pairs_of_all_labelled_documents(spark):
    """Weights and threshold are those of every pair and every row, in memory and over partitions."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, len(ranking.FEATURES)))
    y = (x[:, 2] + rng.normal(size=150) < 0.4).astype(int)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "label int, x array<double>").repartition(3)
    for model in (ranking.fit_ranker(x, y), ranking.fit_sums(ranking.sums_of_rows(rows))):
        assert np.allclose(model.weights, all_pairs_weights(model, x, y), atol=2e-3)
        assert model.threshold == pytest.approx(np.quantile(model.strengths(x), np.mean(y == 0)), abs=1e-9)


def test_every_labelled_document_is_learnt_from(spark):
    """More labelled documents than once were sampled: each of them is a training row."""
    n = 30_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('word here ', id % 7, if(id % 3 = 0, ' ### $', ' plain')) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "int(id % 3 != 0) as quality", "0 as toxic")
    seen = []

    def watched(sums):
        seen.append(int(ranking._total(sums, lambda x, y: np.ones((len(y), 1)), 1)[0]))
        return ranking.Ranker(np.zeros(14), np.ones(14), np.zeros(28), 0.0, 0.3)

    real, ranking.fit_sums = ranking.fit_sums, lambda sums, cut: watched(sums)
    try:
        ranking.score(docs, labels)
    finally:
        ranking.fit_sums = real
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(n))]
