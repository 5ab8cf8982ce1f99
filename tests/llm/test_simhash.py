"""SimHash components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from varfold.llm import simhash
from varfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_print(text: str | None, words: int) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(lowered)
    if not found:
        return 0
    parts = [" ".join(found)] if len(found) < words else [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids: list, prints: list[int], most: int) -> list:
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least: dict[int, list] = {}
    for i, d in enumerate(ids):
        least.setdefault(find(i), []).append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(ids))]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids, prints = [r.doc_id for r in rows], [slow_print(r.text, 4) for r in rows]
    want = {(d, f"{p:016x}", c) for d, p, c in zip(ids, prints, slow_components(ids, prints, 4), strict=True)}
    got = QUERIES["op1_simhash"](spark, SF).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want


def test_hard_rows(spark):
    texts = [None, "", " \n\t", "one", "ONE", "one two three four", "One  two\nthree FOUR", "a " * 60_000, "a " * 60_000, "é" * 9, "x" * 200_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "one", "c"), (5, texts[5], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(docs).collect()), key=str)
    prints = [slow_print(t, 4) for _, t, _ in rows]
    want = sorted(zip([r[0] for r in rows], prints, slow_components([r[0] for r in rows], prints, 4), strict=True), key=str)
    assert got == want
    empty = simhash.simhash_components(docs.limit(0))
    assert empty.collect() == []


@pytest.mark.parametrize("rows", [8, simhash.CELL_ROWS])
def test_dense_groups_keep_their_links(spark, monkeypatch, rows):
    """Chains of near fingerprints, in cells that are cut into chunks or not."""
    monkeypatch.setattr(simhash, "CELL_ROWS", rows)
    rnd, prints = random.Random(5), []
    for _ in range(6):
        fp = rnd.getrandbits(64)
        for _ in range(40):
            prints.append(fp)
            for _ in range(rnd.choice([1, 3, 4, 5])):
                fp ^= 1 << rnd.randrange(64)
    ids = list(range(len(prints)))
    frame = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in zip(ids, prints, strict=True)], "id long, fp long")
    edges = simhash.links(simhash.grid_cells(frame.select("fp").distinct(), 4), 4)
    got = {r.id: r.component_id for r in simhash.assign_components(frame, edges).collect()}
    assert [got[i] for i in ids] == slow_components(ids, prints, 4)


@pytest.mark.parametrize("exact", [1, 4])
def test_finer_cells_lose_no_link(spark, exact):
    rnd, prints = random.Random(9), []
    for _ in range(8):
        fp = rnd.getrandbits(64)
        for _ in range(25):
            prints.append(fp)
            for _ in range(rnd.choice([2, 4, 4, 5])):
                fp ^= 1 << rnd.randrange(64)
    frame = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)], "id long, fp long")
    cells = simhash.grid_cells(frame.select("fp").distinct(), 4, exact)
    got = {r.id: r.component_id for r in simhash.assign_components(frame, simhash.links(cells, 4)).collect()}
    assert [got[i] for i in range(len(prints))] == slow_components(list(range(len(prints))), prints, 4)
    assert cells.select("cell").distinct().count() > simhash.grid_cells(frame.select("fp").distinct(), 4).select("cell").distinct().count()


def test_cells_grow_finer_with_the_number_of_fingerprints():
    found = [simhash.exact_segments(n) for n in (0, 10**6, 2 * 10**7, 10**8, 10**9, 10**10, 5 * 10**10, 10**12)]
    assert found[:3] == [0, 0, 0] and found[-1] == 4 and found == sorted(found)
    assert all(n * (3 / 8) ** (16 - 4 * e) * (1 / 4) ** (4 * e) <= 4 * simhash.FELLOWS for n, e in zip((10**8, 10**9, 10**10, 5 * 10**10), found[3:7], strict=True))


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    from varfold.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, -1, id % 500) as k", "cast(null as string) as note")
    ones = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("value", F.col("k") * 7)
    got = common.join_one(rows, ones, "k", "n")
    assert got.columns == ["k", "id", "note", "value"] and "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.k, r.value) for r in got.collect()) == [(i, -1 if i % 3 == 0 else i % 500, 7 * (-1 if i % 3 == 0 else i % 500)) for i in range(3000)]


def test_bound_is_below_hamming():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)
    slow = [sum(abs((int(x) >> s & 3).bit_count() - (int(y) >> s & 3).bit_count()) for s in range(0, 64, 2)) for x, y in zip(a, b, strict=True)]
    got = simhash.manhattan(simhash.counts_of(a), simhash.counts_of(b))
    assert got.tolist() == slow
    assert (got <= np.bitwise_count(a ^ b)).all()


def test_keep_one(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(300)] for _ in range(30)]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(base)]
    for i, w in enumerate(base[:10]):
        near = list(w)
        near[rnd.randrange(300)] = word()
        rows += [(100 + i, " ".join(near), "s"), (200 + i, " ".join(w), "s")]
    rows += [(None, None, None), (300, None, "s"), (301, "", "s"), rows[25]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(30), 300, None], key=str)
    assert simhash.keep_one(docs.where(F.lit(False))).count() == 0
