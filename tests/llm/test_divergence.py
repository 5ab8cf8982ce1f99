"""Distances of sources against SQL and a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varfold.llm import divergence

SF = "/root/testdata/sf0.01"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows: list[tuple], least: int, most: int) -> set[tuple]:
    """Term by term for all pairs; rows are (lang, source, text)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = [t.translate(LOW) for t in TERM.findall(text)]
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = sorted(s for a, s in counts if a == lang)
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))
        size = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], size[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(size.values())) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((q[t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(pairs, 1)}
            out |= {(lang, s, "term", t, -v, i) for i, (v, t) in enumerate(terms[:most], 1)}
    return out


def made() -> list[tuple]:
    rnd = random.Random(5)
    words = ["the", "The", "straße", "STRASSE", "Éa", "éa", "x1y", "don't", "日本", "\U0001f600", "İ", "a b", "zz"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "Ωs", "s\U0001f600", None]), " ".join(rnd.choices(words, k=rnd.randrange(0, 60)))) for _ in range(300)]
    rows += rows[:5] + [("en", "s1", None), ("xx", "lonely", "rare words only"), ("yy", "a", ""), ("yy", "b", None), ("en", "silent", "12 34 !?"), ("en", "hot", "the " * 5000)]
    return rows


@pytest.mark.parametrize(("least", "most", "unit", "piece"), [(1, 3, 1024, 1 << 20), (8, 50, 2, 7), (40, 50, 1, 64)])
def test_equals_plain_version(spark, monkeypatch, least, most, unit, piece):
    monkeypatch.setattr(divergence, "UNIT", unit)
    monkeypatch.setattr(divergence, "PIECE", piece)
    rows = made()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = divergence.divergences(docs.repartition(5), least_docs=least, terms=most).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain(rows, least, most)
    assert {r.value for r in got if r.lang in ("xx", "yy")} <= {0} or least == 1


def test_terms_in_pieces(monkeypatch):
    text = "Ein Straße-Test, 日本語 ABC0def " * 30
    whole = [t.translate(LOW).encode() for t in TERM.findall(text)]
    for piece in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(divergence, "PIECE", piece)
        assert [t for part in divergence.terms_of(text.encode()) for t in part] == whole


def test_counts_are_handed_on_in_parts(monkeypatch):
    """However often a task hands on, sums are the same, and a document counts once for a term."""
    rows = [(a or "", s or "", (t or "").encode()) for a, s, t in made()]
    sums = []
    for held in (0, 1 << 18):
        monkeypatch.setattr(divergence, "HELD", held)
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 7], strict=True)], ["lang", "source", "text"]) for i in range(0, len(rows), 7)]
        total: Counter = Counter()
        out = list(divergence._count(iter(batches)))
        for lang, source, term, n, docs in (r for b in out for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            total[lang, source, term, "n"] += n
            total[lang, source, term, "docs"] += docs
        sums.append((total, len(out)))
    assert sums[0][0] == sums[1][0] and sums[0][1] > sums[1][1] == len({r[:2] for r in rows})


def test_shares_are_exact_beyond_long(spark):
    big = 9 * 10**18
    df = spark.range(1).select(divergence.share(F.lit(big), F.lit(big), F.lit(3)).alias("a"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("b"), divergence.share(F.lit(7), F.lit(20), F.lit(4)).alias("c"))
    assert tuple(df.first()) == (1 + 10**9 * (big + 5) // (big + 15), None, 1 + 10**9 * 12 // 40)


def test_empty_table(spark):
    assert divergence.divergences(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = divergence.op12_divergence(spark, SF)
    want = con.execute(divergence.OP12_SQL)
    assert df.columns == [d[0] for d in want.description]
    assert dict(df.dtypes)["value"] == "bigint" and dict(df.dtypes)["rank"] == "int"
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
