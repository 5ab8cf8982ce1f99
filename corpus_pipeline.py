"""A training-data pipeline over ``documents``: five stages, each one operator over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``:

1. quality: documents that the quality classifier scores below 0.7 go;
2. near_dedup: of each group of near-duplicates the document with the smallest id stays;
3. decontaminate: documents in which a benchmark item occurs within its error budget go;
4. secrets: secrets in the texts are replaced by a mark, and n_chars is set anew;
5. segmentation: each text becomes four sampled segmentations (ids as four bytes little-endian a piece) with inclusion scores.

Defined results: rows with null texts count as empty texts in every stage, and null texts stay null until segmentation. Exact
repeats of id and text become one row in near_dedup, copies and near-copies the one with the smallest id; rows without an id
all stay there. Where several rows are alike in every respect, it does not matter which stays: ties are settled by the other columns.
Whole texts are taken, however long. Columns beyond those of ``documents`` are carried through, whatever their names; the last
stage has its own. An empty table gives an empty result.
SQL cannot express the stages, so ORACLE_SQL is None and tests/llm/test_pipeline.py holds them against plain versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varfold.llm.common import SharedTable, table
from varfold.llm.decontaminate import drop_contaminated
from varfold.llm.quality import document_statistics, fit_quality, keep_quality, training_rows
from varfold.llm.secrets import redact_secrets
from varfold.llm.segmentation import default_model, sample_segmentations
from varfold.llm.simhash import keep_one

#: Segmentations of each text, as many as ``op2_segmentations`` takes.
SEGMENTATIONS = 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, learnt from all labelled ones among them, scores 0.7 or more."""
    found = document_statistics(docs)
    model = fit_quality(training_rows(found, table(spark, sf_dir, "labels"), "quality", 1, 1))
    return keep_quality(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group at a Jaccard index of 0.8 over five-word shingles: SimHash grid first, an exact path for the rest."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark."""
    return redact_secrets(docs, chars_col="n_chars")


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each text."""
    found = sample_segmentations(docs, default_model(), SEGMENTATIONS)
    return found.select(F.col("id").alias("doc_id"), "rank", "ids", "n_pieces", "log_prob", "inclusion")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("segmentation", segmentation),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = SharedTable(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return docs
