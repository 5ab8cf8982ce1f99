"""Every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from varfold.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def canonical(rows: list[tuple]) -> list:
    fixed = [tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows]
    return sorted(fixed, key=lambda r: tuple((v is None, str(v)) for v in r))


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = canonical([tuple(r[c] for c in names) for r in df.collect()])
    found = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    kinds = dict(zip(columns, (str(d[1]) for d in found.description), strict=True))
    want = canonical([tuple(r[columns.index(c)] for c in names) for r in found.fetchall()])
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    assert {n: KINDS[t] for n, t in df.dtypes} == {n: k.replace("NUMBER", kinds[n]) for n, k in kinds.items()}


def test_all_queries_have_sql_or_are_fits():
    assert set(QUERIES) - set(ORACLE_SQL) == {"germline_mle", "somatic_mixture", "fit_arm", "fit_sample_arm", "predicted"}
