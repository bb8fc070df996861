"""The ranker's fit takes every labelled row and every pair."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomquant.llm import preference_quality as pq


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["good", "Bad#", "x1", "some words", "\n", "%%", "the", "end."], int(rng.integers(5, 60))))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t.count("#") * 9 < len(t.split()) + rng.integers(0, 9))) for i, t in rows], "doc_id long, quality int")
    used = {r["doc_id"] for r in docs.where(~pq.held_out(F.col("doc_id"))).collect()}
    quality = np.array([r["quality"] for r in labels.orderBy("doc_id").collect()])
    some = [i for i, _ in rows if i in used]
    texts = [rows[i][1].encode() for i in some]
    x = pq.features(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    return docs, labels, x, quality[some]


def test_fit_is_the_least_loss_of_all_pairs(spark, labelled):
    docs, labels, x, quality = labelled
    got = pq.fit_ranker(docs, labels)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    assert got.center == pytest.approx(x.mean(axis=0)) and got.scale == pytest.approx(x.std(axis=0) + 1e-6)
    good, poor = z[quality == 1], z[quality == 0]
    assert len(good) > 20 and len(poor) > 20
    d = (good[:, None, :] - poor[None, :, :]).reshape(-1, z.shape[1])

    def gradient(w):
        return -d.T @ (1 - 1 / (1 + np.exp(-d @ w))) / len(d) + w / 6000

    assert np.abs(gradient(got.weights)).max() < 1e-4 < 1e-2 < np.abs(gradient(np.zeros(len(got.weights)))).max()
    s = z @ got.weights
    assert got.threshold == pytest.approx(np.quantile(s, len(poor) / len(s))) and got.spread == pytest.approx(s.std())


def test_every_label_counts(spark, labelled):
    docs, labels, x, quality = labelled
    twice = labels.unionAll(labels).unionAll(labels.where("quality = 1"))  # rows with several labels count for each
    got = pq.fit_ranker(docs, twice)
    n = np.where(quality == 1, 3, 2)
    assert got.center == pytest.approx(np.average(x, axis=0, weights=n))
