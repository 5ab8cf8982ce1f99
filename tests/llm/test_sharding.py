"""Sharding against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from varfold.llm.queries import QUERIES
from varfold.llm.sharding import shard_by_bytes

SF = "/root/testdata/sf0.01"


def slow_capacity(sizes: list[int], shards: int) -> int:
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        now = list(best)
        for i in range(1, len(sizes) + 1):
            total = 0
            for j in range(i, 0, -1):
                total += sizes[j - 1]
                now[i] = min(now[i], max(best[j - 1], total))
        best = now
    return best[-1]


def fast_capacity(sizes: list[int], shards: int) -> int:
    capacity = max(max(sizes), -(-sum(sizes) // shards))
    while True:
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= shards:
            return capacity
        capacity += 1


def check(rows: list, got: list, shards: int, capacity) -> None:
    sizes, of = defaultdict(int), {}
    for _, t, *_ in rows:
        sizes[hashlib.sha256((t or "").encode()).digest()] += len((t or "").encode()) + 1
    ordered = [sizes[k] for k in sorted(sizes)]
    totals, slots = defaultdict(int), defaultdict(list)
    assert len(got) == len(rows)
    by_id = {r["doc_id" if "doc_id" in r else "id"]: r for r in got}
    for d, t, *_ in rows:
        r, raw = by_id[d], (t or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        assert of.setdefault(t or "", r["shard"]) == r["shard"]
    for r in got:
        totals[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(totals) <= set(range(shards))
    assert max(totals.values()) == capacity(ordered, shards)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [r.asDict() for r in QUERIES["op7_sharding"](spark, SF).collect()]
    check(rows, got, 8, fast_capacity)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


@pytest.mark.parametrize("seed", range(4))
def test_hot_group_and_hard_rows(spark, seed):
    rnd = random.Random(seed)
    texts = [None, "", "", "x" * 50_000] + ["hot " * rnd.choice([1, 50])] * 100 + ["w" * rnd.choice([1, 5, 900, 4000]) + str(i) for i in range(rnd.choice([3, 60]))]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    shards = rnd.choice([1, 3, 8])
    check(rows, [r.asDict() for r in shard_by_bytes(docs, shards).collect()], shards, slow_capacity)


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert shard_by_bytes(docs.limit(0)).collect() == []
    got = shard_by_bytes(docs).collect()
    assert len(got) == 3 and {r.size for r in got if r.id is None} == {2}
