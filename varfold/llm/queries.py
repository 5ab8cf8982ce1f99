"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varfold.llm.decontaminate import op10_decontaminate
from varfold.llm.digests import op3_digests
from varfold.llm.divergence import OP12_SQL, op12_divergence
from varfold.llm.licenses import op6_licenses
from varfold.llm.pii import op8_pii
from varfold.llm.quality import op9_quality
from varfold.llm.repeats import OP11_SQL, op11_repeats
from varfold.llm.secrets import op4_secrets
from varfold.llm.segmentation import op2_segmentations
from varfold.llm.sharding import op7_sharding
from varfold.llm.simhash import op1_simhash
from varfold.llm.toxicity import op5_toxicity
from varfold.llm.whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_segmentations": op2_segmentations,
    "op3_digests": op3_digests,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_decontaminate": op10_decontaminate,
    "op11_repeats": op11_repeats,
    "op12_divergence": op12_divergence,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op11_repeats": OP11_SQL, "op12_divergence": OP12_SQL}
