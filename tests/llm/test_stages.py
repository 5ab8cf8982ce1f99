"""What the pipeline's stages share with the operators they are made of."""

from __future__ import annotations

import inspect
import os

import pyarrow as pa
import pytest

from varfold.llm import quality
from varfold.llm.common import SharedTable, drop_tables
from varfold.llm.segmentation import sample_segmentations

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_segmentation_draws_as_many_as_the_operator(spark):
    text = "The quick brown fox jumps over the lazy dog, again and again and again."
    docs = spark.createDataFrame([(1, text), (2, text.upper())], "doc_id long, text string")
    got = corpus_pipeline.segmentation(spark, docs, "").groupBy("doc_id").count().collect()
    assert {(r.doc_id, r["count"]) for r in got} == {(d, inspect.signature(sample_segmentations).parameters["k"].default) for d in (1, 2)}


def test_tables_on_the_way_can_be_dropped(spark):
    kept = SharedTable(spark.range(5), "kept")
    assert kept.path in SharedTable.written and kept.df.count() == 5
    gone = SharedTable(spark.range(3), "gone")
    gone.drop()
    SharedTable.written[:], others = [kept.path], list(SharedTable.written)
    assert drop_tables(spark) == 1 and not os.path.exists(kept.path.removeprefix("file:"))
    SharedTable.written[:] = [p for p in others if p != kept.path]


def test_texts_are_filtered_in_small_blocks(monkeypatch):
    """keep_quality took the statistics of 4 MB of text together, some 100 bytes of memory for each byte."""
    sizes, taken = [], quality.statistics
    monkeypatch.setattr(quality, "statistics", lambda texts: sizes.append(sum(map(len, texts))) or taken(texts))

    class Docs:
        schema = None

        def mapInArrow(self, run, schema):
            return run

    model = quality._constant(0.9)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["some words " * 10_000] * 40)], ["doc_id", "text"])
    kept = list(quality.keep_quality(Docs(), model)(iter([batch])))
    assert max(sizes) <= quality.TOGETHER and sum(sizes) == 40 * 110_000
    assert pa.Table.from_batches(kept).equals(pa.Table.from_batches([batch]))
