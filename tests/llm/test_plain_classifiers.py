"""The classifiers against plain versions: FTRL one row and one coordinate at a time, and densities by direct solving."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varfold.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def sign(x: float) -> float:
    return (x > 0) - (x < 0)


class PlainFtrl:
    """FTRL-proximal as published: lazily computed weights, a rate for each coordinate, L1 and L2; the bias has neither."""

    def __init__(self) -> None:
        self.z: dict[int, float] = {}
        self.n: dict[int, float] = {}

    def weight(self, i: int) -> float:
        z, n = self.z.get(i, 0.0), self.n.get(i, 0.0)
        l1, l2 = (toxicity.L1, toxicity.L2) if i >= 0 else (0.0, 0.0)
        if abs(z) <= l1:
            return 0.0
        return -(z - sign(z) * l1) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA + l2)

    def learn(self, slots: list[int], label: int) -> None:
        weights = {i: self.weight(i) for i in [*slots, -1]}
        g = 1 / (1 + math.exp(-sum(weights.values()))) - label
        for i, w in weights.items():
            n = self.n.get(i, 0.0)
            sigma = (math.sqrt(n + g * g) - math.sqrt(n)) / toxicity.ALPHA
            self.z[i] = self.z.get(i, 0.0) + g - sigma * w
            self.n[i] = n + g * g


@pytest.mark.parametrize("updates", [150, 1003])
def test_learner_equals_plain_ftrl(spark, updates):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").orderBy("doc_id").limit(200)
    got = toxicity.fit_toxicity(docs, labels, "toxic", updates=updates)
    texts = {r.doc_id: r.text for r in docs.collect()}
    turns = -(-updates // labels.count())
    order = labels.select("doc_id", "toxic", F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("turn")).orderBy("turn", F.xxhash64("doc_id", "turn"), "doc_id").limit(updates)
    plain = PlainFtrl()
    for r in order.collect():
        plain.learn(sorted(set(toxicity.features([texts[r.doc_id]])[1].tolist())), r.toxic)
    want = {i: plain.weight(i) for i in plain.z}
    want = {i: w for i, w in want.items() if w or i == -1}
    assert got.keys() == want.keys() and (updates < 1000 or len(got) > 5)
    assert all(got[i] == pytest.approx(w, rel=1e-6, abs=1e-9) for i, w in want.items())
    scores = {r.id: r.score for r in toxicity.score_toxicity(docs, got).collect()}
    for d, text in list(texts.items())[:100]:
        total = sum(want.get(i, 0.0) for i in set(toxicity.features([text])[1].tolist())) + want[-1]
        assert scores[d] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-6)


def test_densities_equal_plain_discriminant(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").orderBy("doc_id").limit(200)
    rows = quality.training_rows(quality.document_statistics(docs), labels, "quality", 4, 2)
    model = quality.fit_quality(rows)
    data = rows.toPandas()
    x, y = data[list(quality.FEATURES)].to_numpy(), data["label"].to_numpy()
    assert 100 < len(x) < 200
    covariance = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).sum() * covariance[c] for c in (0, 1)) / len(y)
    density = []
    for c in (0, 1):
        s = (1 - quality.POOLED) * covariance[c] + quality.POOLED * pooled
        s = (1 - quality.DIAGONAL) * s + quality.DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(s))
        away = x - x[y == c].mean(0)
        density.append([-0.5 * (a @ np.linalg.solve(s, a) + np.linalg.slogdet(s)[1]) for a in away])
    want = np.array(density[1]) - np.array(density[0])
    assert np.allclose(model.difference(x), want, rtol=1e-6, atol=1e-6)
    # The calibration is the best logistic curve over the binned differences: nothing around it has a larger penalised likelihood.
    bins = np.round(np.clip(want, -60, 60) * 4) / 4

    def value(slope: float, offset: float) -> float:
        p = np.clip(1 / (1 + np.exp(-(slope * bins + offset))), 1e-300, 1 - 1e-16)
        return float(np.where(y == 1, np.log(p), np.log(1 - p)).sum() - 0.5e-3 * slope**2)

    best = value(model.slope, model.offset)
    for d in (-1e-3, 1e-3):
        assert value(model.slope + d, model.offset) <= best + 1e-6 and value(model.slope, model.offset + d) <= best + 1e-6
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(model.slope * np.clip(want, -60, 60) + model.offset))), atol=1e-6)
