"""Quality and toxicity classifiers: held-out accuracy, folds, hard rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from varfold.llm import quality, toxicity
from varfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "label", "folds", "out", "least", "need"), [("op9_quality", "quality", 4, 2, 0.7, 0.9), ("op5_toxicity", "toxic", 5, 0, 0.5, 0.93)])
def test_held_out(spark, name, label, folds, out, least, need):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert [zlib.crc32(str(d).encode()) % folds == out for d in got.doc_id] == got.held_out.tolist()
    assert got.score.between(0, 1).all() and ((got.score >= least).astype(int) == got.predicted).all()
    known = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    known = known[known.held_out]
    right = (known.predicted == known[label]).mean()
    rank = known.score.rank()
    ones = known[label] == 1
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    print(name, "held-out accuracy", right, "AUC", auc, "recall", known.predicted[ones].mean(), "false", known.predicted[~ones].mean())
    assert right >= need


def hard(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "word " * 50_000), (None, "no id"), (5, "Ünïcode ÄÖ\U0001f600 text"), (5, "repeated id"), (6, "x" * 300_000)]
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, label string, score double")


LABELS = "doc_id long, label int"


def test_quality_hard_rows(spark):
    docs = hard(spark)
    found = quality.document_statistics(docs)
    for labels in ([], [(1, 1)], [(i, i % 2) for i in (1, 2, 3, 4, 5, 6)] + [(1, None), (2, 7), (None, 1)]):
        model = quality.fit_quality(quality.training_rows(found, spark.createDataFrame(labels, LABELS), "label", 4, 9))
        got = quality.score_quality(found, model).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
        kept = quality.keep_quality(docs, model)
        assert kept.columns == docs.columns
        assert kept.count() == sum(r.score >= quality.KEEP for r in got)
    assert quality.score_quality(quality.document_statistics(docs.limit(0)), model).collect() == []


def test_statistics_do_not_depend_on_neighbours():
    texts = ["one two two\nTHREE!\nTHREE!", "", "a1 $$ é", " \n", "x" * 70_000 + " y", "Zoë"]
    together = quality.statistics(texts)
    alone = np.concatenate([quality.statistics([t]) for t in texts])
    assert np.allclose(together, alone)
    words = [len(t.split()) for t in texts]
    assert np.allclose(np.expm1(together[:, 0]), words)
    assert np.isclose(together[0, 9], np.log1p(4) / np.log1p(5)) or np.isclose(together[0, 9], np.log1p(3) / np.log1p(5))
    assert np.isclose(together[0, 11] ** 2, 1 / 3)


def test_toxicity_hard_rows(spark):
    docs = hard(spark)
    for labels in ([], [(1, 1)], [(i, i % 2) for i in range(1, 7)] + [(1, None), (2, 7), (None, 1)]):
        weights = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, LABELS))
        got = toxicity.score_toxicity(docs, weights).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
        if not labels:
            assert {r.score for r in got} == {0.5}
    assert toxicity.score_toxicity(docs.where(F.lit(False)), weights).collect() == []


def test_toxicity_features_do_not_depend_on_neighbours():
    texts = ["You are, a FOOL", "", "you-are a fool", "é\x00é", None]
    doc, slot = toxicity.features(texts)
    got = [sorted(slot[doc == i]) for i in range(len(texts))]
    assert got == [sorted(toxicity.features([t])[1]) for t in texts]
    assert got[0] == got[2] and len(got[0]) == 4 + 3 + 2 and not got[1] and len(got[3]) == 3
