"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from varfold.llm import decontaminate, segmentation
from varfold.llm import quality as q
from varfold.llm.common import SharedTable

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(SharedTable(stage(spark, frames[-1], SF), name).df)
    return [f.toPandas() for f in frames], [f.columns for f in frames]


def test_columns_stay(stages):
    _, columns = stages
    assert all(c == columns[0] for c in columns[:-1])


def test_quality_keeps_good_documents(spark, stages):
    docs, kept = stages[0][:2]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    known = docs.merge(labels, on="doc_id")
    stays = known.doc_id.isin(kept.doc_id)
    assert stays[known.quality == 1].mean() > 0.97
    assert stays[known.quality == 0].mean() < 0.4
    assert len(q.statistics(["x"])[0]) == len(q.FEATURES)


def shingle_set(text: str) -> set:
    w = [x.lower() for x in re.findall("[^\x20\x09-\x0d]+", text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_near_duplicates_go_and_others_stay(stages):
    before, after = stages[0][1:3]
    sets = dict(zip(before.doc_id, map(shingle_set, before.text), strict=True))
    gone = set(before.doc_id) - set(after.doc_id)
    like = lambda a, b: len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1)
    kept = list(after.doc_id)
    assert gone and after.text.is_unique
    for i, a in enumerate(kept):
        for b in kept[:i]:
            assert sets[a].isdisjoint(sets[b]) or like(a, b) < 0.8, (a, b, like(a, b))
    for a in gone:  # every document that went is that like some other one
        assert max(like(a, b) for b in before.doc_id if b != a) >= 0.8


def test_decontamination(spark, stages):
    before, after = stages[0][2:4]
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = before.text.map(lambda t: any(i in decontaminate.normalise(t) for i in items))
    assert hit.any() and set(after.doc_id) == set(before.doc_id[~hit])


def test_secrets_go(stages):
    before, after = stages[0][3:5]
    assert list(sorted(after.doc_id)) == list(sorted(before.doc_id))
    both = before.merge(after, on="doc_id")
    changed = both[both.text_x != both.text_y]
    assert len(changed) and changed.text_y.str.contains("[SECRET]", regex=False).all()
    assert (after.n_chars == after.text.str.len()).all()
    assert not after.text.str.contains("[0-9a-f]{32}").any()


def test_segmentations_decode(stages):
    before, after = stages[0][4:6]
    spelt = segmentation.Vocabulary.load(segmentation.default_model()).piece_bytes()
    texts = dict(zip(before.doc_id, before.text, strict=True))
    assert set(after.doc_id) == set(texts)
    assert all(segmentation.decode(np.frombuffer(r.ids, "<i4"), spelt) == texts[r.doc_id] for r in after.itertuples())


def test_run_and_empty(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


CLASHES = ("id", "fp", "root", "spans", "base", "label", "__base", "__clean", "__copy", "__kept", "__id", "cell", "score", "item")


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Null, empty, repeated, tied and very long texts, null ids, and columns whose names the operators use themselves."""
    folder = str(tmp_path_factory.mktemp("hard"))
    good = [r.text for r in spark.sql(f"select text from parquet.`{SF}/documents.parquet` join parquet.`{SF}/labels.parquet` using (doc_id) where quality = 1 order by doc_id limit 40").collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    halves = lambda a, b: a[: len(a) // 2] + " " + b[len(b) // 2 :]
    long = " ".join(good)
    long = (long + "\n") * (1_000_000 // len(long) + 1)
    texts = {i: t for i, t in enumerate(good)}
    rows = [*texts.items(), (100, None), (101, ""), (102, " \n"), (103, good[3]), (103, good[3]), (104, good[3].upper()), (None, good[5]), (None, None)]
    rows += [(105, long), (106, halves(good[7], good[9]) + "\n" + item.upper()), (107, halves(good[8], good[10]) + " password=hunter2hunter2 end"), (108, "\U0001f600é" * 50), (109, "x" * 50_000)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in [*range(40), 101, 102, 108, 109]] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(rows), docs


def test_every_stage_takes_hard_rows(spark, hard):
    folder, texts, docs = hard
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(SharedTable(stage(spark, frames[-1], folder), name).df)
        if name != "segmentation":
            assert sorted(frames[-1].columns) == sorted(docs.columns)
            assert frames[-1].where(" or ".join(f"`{c}` <> 'clash'" for c in CLASHES)).count() == 0
    found = [f.collect() for f in frames]
    ids = [sorted((r.doc_id for r in rows), key=str) for rows in found]
    assert set(range(40)) <= set(ids[1]) and 105 in ids[1]
    # Repeats and copies go, documents of no id stay, and unlike ones do.
    assert set(ids[2]) == set(ids[1]) - {103, 104} and len(set(ids[2])) <= len(ids[2]) <= len(set(ids[2])) + 1
    assert 106 not in ids[3] and set(ids[3]) <= set(ids[2])
    clean = {r.doc_id: r.text for r in found[4]}
    assert len(found[4]) == len(found[3]) and all("hunter2" not in (t or "") for t in clean.values())
    assert {d: t for d, t in clean.items() if d not in (107, None) and "[SECRET]" not in (t or "")}.items() <= texts.items()
    spelt = segmentation.Vocabulary.load(segmentation.default_model()).piece_bytes()
    for r in found[5]:
        if r.doc_id is not None:
            assert segmentation.decode(np.frombuffer(r.ids, "<i4"), spelt) == (clean[r.doc_id] or "")
    assert {r.doc_id for r in found[5]} == set(ids[4])


def test_every_stage_takes_empty_tables(spark, hard):
    folder, _, docs = hard
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name
