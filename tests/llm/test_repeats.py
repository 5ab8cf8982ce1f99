"""Removal of repeated passages against a plain version and SQL."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from varfold.llm import repeats

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(docs: list[tuple[int, str | None]], window: int) -> dict[int, tuple[int, int, str]]:
    """Documents in the order of their ids, window by window."""
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                gone.update(range(i, i + window))
            seen.add(run)
        out[d] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def passages(seed: int, window: int) -> list[tuple[int, str]]:
    """Texts cut and pasted from each other: passages around the window's length, in old and new contexts, repeats within a text."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "É", "\U0001f600x", "long" * 5]) if rnd.random() < 0.2 else f"w{rnd.randrange(400)}"
    fresh = lambda n: [word() for _ in range(n)]
    line, out = fresh(window + 3), [fresh(rnd.randrange(1, 6 * window)) for _ in range(10)]
    while len(out) < 90:
        made: list[str] = []
        for _ in range(rnd.randrange(1, 6)):
            kind = rnd.randrange(5)
            old = rnd.choice(out)
            at = rnd.randrange(len(old))
            if kind == 0:
                made += fresh(rnd.randrange(1, window))
            elif kind == 1:
                made += line[rnd.randrange(3) :]
            elif kind == 2 and made:
                made += made[at % len(made) :]
            else:
                made += old[at : at + rnd.choice([window - 1, window, window + 1, 3 * window, 10 * window])]
        out.append(made)
    out += [out[20], out[20], ["one"] * (3 * window), [], ["x"]]
    ids = rnd.sample(range(-50, 1000), len(out))
    return [(d, rnd.choice([" ", "\n", " \t "]).join(t)) for d, t in zip(ids, out, strict=True)]


def found(spark, rows: list[tuple], window: int, parts: int = 3) -> dict[int, tuple[int, int, str]]:
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {r.id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(docs, window=window).collect()}


@pytest.mark.parametrize(("seed", "window", "block"), [(1, 20, 8 << 20), (2, 20, 300), (3, 5, 200), (4, 9, 1000), (5, 2, 50)])
def test_equals_plain_version(spark, monkeypatch, seed, window, block):
    """In blocks of any size, of which small ones cut texts into pieces."""
    rows = passages(seed, window)
    monkeypatch.setattr(repeats, "BLOCK", block)
    assert found(spark, rows, window) == plain(rows, window)


def local(rows: list[tuple], window: int, frequent: np.ndarray) -> list[tuple]:
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([0] * len(rows), pa.int64()), pa.array([t.encode() for _, t in rows], pa.binary())], ["doc", "sub", "text"])
    out = list(repeats._phrase_rows(window, frequent)(iter([batch])))
    return [r for b in out for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]


@pytest.mark.parametrize("block", [60, 500, 1 << 20])
def test_pieces_have_each_window_once(monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    text = " ".join(f"w{i}" * (1 + i % 3) for i in range(900)) + " " + "y" * 700 + " end \n"
    words, seen = text.split(), []
    for first, piece in repeats.pieces_of(text.encode(), 20):
        own = piece.decode().split()
        assert own == words[first : first + len(own)]
        seen += range(first, first + len(own) - 19)
    assert seen == list(range(len(words) - 19))


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_phrases_of_a_block_cover_its_windows(monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    rows = [(i, t) for i, (_, t) in enumerate(passages(7, 20))]
    covered = {}
    for _, _, _, doc, _, start, n, ref_doc, _, ref_start in local(rows, 20, np.empty(0, np.uint64)):
        for k in range(n):
            assert covered.setdefault((doc, start + k), (ref_doc, ref_start)) == (ref_doc, ref_start)
        if ref_doc is not None:
            a, b = (rows[d][1].split()[s : s + n + 19] for d, s in ((doc, start), (ref_doc, ref_start)))
            assert a == b and (ref_doc, ref_start) < (doc, start)
    assert set(covered) == {(i, s) for i, t in rows for s in range(len(t.split()) - 19)}


def test_frequent_anchors_are_dealt_out(spark, monkeypatch):
    """An anchor held as frequent has all its phrases checked, wherever they meet."""
    rows = passages(8, 20)
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "FREQUENT", 2)
    assert len(repeats._frequent(repeats._with_places(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"), 20)) > 10
    assert found(spark, rows, 20) == plain(rows, 20)


def test_factors_point_to_earlier_text(spark):
    rows = passages(9, 20)
    words = {d: t.split() for d, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove_repeats(docs).collect()
    assert sum(len(r.factors) for r in got) > 50
    for r in got:
        for f in r.factors:
            assert f.words >= 20 and (f.ref_id, f.ref_start) < (r.id, f.start)
            assert words[r.id][f.start : f.start + f.words] == words[f.ref_id][f.ref_start : f.ref_start + f.words]
    assert max(f.words for r in got for f in r.factors) > 60  # phrases in step are one factor


def test_hard_rows(spark):
    """Null and empty texts, null and repeated ids, repeated rows, clashing columns, very long texts and words."""
    base = " ".join(f"b{i}" for i in range(40))
    long = " ".join(f"l{i}" for i in range(300_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, base), (4, base), (5, base + " more"), (None, base), (None, base), (None, "new " + base), (6, long), (7, "start " + long), (8, "z" * 3_000_000), (9, "z" * 3_000_000)]
    rows += [(10, "same id " + " ".join(f"s{i}" for i in range(30))), (10, "other text " + " ".join(f"s{i}" for i in range(30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "doc", "sub", "start", "n", "cell", "kept", "factors", "ref_doc"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = sorted(((r.id, r.n_words, r.n_removed) for r in repeats.remove_repeats(docs).collect()), key=str)
    nulls = [g for g in got if g[0] is None]
    assert sorted(nulls) == sorted([(None, 40, 40)] * 2 + [(None, 41, 40)])
    same = sorted(g[2] for g in got if g[0] == 10)
    assert same == [0, 30]
    want = [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 40, 0), (4, 40, 0), (5, 41, 40), (6, 300_000, 0), (7, 300_001, 300_000), (8, 1, 0), (9, 1, 0)]
    assert sorted(g for g in got if g[0] not in (None, 10)) == want
    assert repeats.remove_repeats(docs.limit(0)).collect() == []


def test_words_are_told_apart():
    texts = [f"{a}{b}" for a in ("a", "é", "", "1" * 5000) for b in range(3000)]
    words, owner = repeats._joined([" ".join(texts).encode(), b"", b"a1 a1"])
    assert len(set(words[:-2].tolist())) == len(texts) and words[-1] == words[-2] == words[1]
    assert owner.tolist() == [0] * len(texts) + [2, 2]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = repeats.op11_repeats(spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.execute(repeats.OP11_SQL).fetchall())
    assert sum(r[2] for r in got) > 10_000
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = plain(list(texts.items()), 20)
    assert got == sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in want.items())
