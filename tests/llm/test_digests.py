"""Bloom-chain digests against a plain version."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from varfold.llm import digests as dg
from varfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_selected(data: bytes) -> list[int]:
    rank = []
    for i in range(len(data) - dg.WINDOW + 1):
        total = sum(int(dg._PART[c]) for c in Counter(data[i : i + dg.WINDOW]).values())
        rank.append(int(dg._rarity(np.array([total]))[0]))
    out = []
    for i, r in enumerate(rank):
        before, after = rank[max(i - dg.RADIUS, 0) : i], rank[i + 1 : i + 1 + dg.RADIUS]
        if r > 0 and all(r > x for x in before) and all(r >= x for x in after):
            out.append(i)
    return out


def samples() -> list[bytes]:
    rnd = random.Random(7)
    words = ["the", "onnth", "whesh", "cióndo", "x9$", "ing"]
    out = [b"", b"short", b"a" * 500, b"ab" * 300, bytes(range(256)) * 3]
    out += [" ".join(rnd.choice(words) + rnd.choice("abcdefgh") * rnd.randint(0, 3) for _ in range(rnd.choice([12, 30, 150]))).encode() for _ in range(12)]
    return out


def test_selection_equals_plain_version():
    texts = samples()
    joined = np.frombuffer(b"\0".join(texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = ends - np.array([len(t) for t in texts])
    at, owner = dg.select(joined, starts, ends)
    for i, t in enumerate(texts):
        assert (at[owner == i] - starts[i]).tolist() == slow_selected(t), t[:40]


def test_digests_do_not_depend_on_neighbours():
    texts = samples()
    assert dg.digests(texts) == [dg.digests([t])[0] for t in texts]


def test_chains_and_likeness():
    rnd = random.Random(1)
    text = lambda n: " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(n)).encode()
    long = text(6000)
    (a,) = dg.digests([long])
    wide = 2 + dg.FILTER_BITS // 8
    counts = [int.from_bytes(a[i : i + 2], "little") for i in range(0, len(a), wide)]
    assert len(counts) > 3 and all(c == dg.FEATURES for c in counts[:-1]) and 0 < counts[-1] <= dg.FEATURES
    for x, y, low, high in [(long, long[: len(long) * 2 // 3] + text(2000), 0.4, 0.95), (long, text(6000), 0, 0.1), (long, b"inserted " + long, 0.9, 1), (text(200), text(200), 0, 0.15)]:
        one, two = dg.digests([x, y])
        assert low <= dg.likeness(one, two) <= high
        assert dg.likeness(one, two) == dg.likeness(two, one)
        assert dg.likeness(one, one) == 1


def slow_edits(rows: list[tuple]) -> dict:
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (d, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 3
        out[d] = (len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())
    return out


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op3_digests"](spark, SF).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == slow_edits(rows)
    long = [r for r in got if r.n_chars > 600]
    assert np.mean([r.near_edited for r in long]) > 0.5 > 0.1 > np.mean([r.near_next for r in long])
    texts = dict(rows)
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_hard_rows(spark, monkeypatch):
    rows = [(i * 37 % 101, t, "clash") for i, t in enumerate([None, "", "é" * 9, "\U0001f600" * 700, "x" * 200_000, "same text here", "same text here", *map(str, range(60))])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    for ranges in (512, 3):
        monkeypatch.setattr(dg, "RANGES", ranges)
        got = dg.compare_with_edits(docs).collect()
        assert {r.id: (r.n_chars, r.edited_sha256) for r in got} == slow_edits([r[:2] for r in rows]) and len(got) == len(rows)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert dg.compare_with_edits(docs.limit(0)).collect() == []
    (one,) = dg.compare_with_edits(docs.where("text = 'same text here'").limit(1)).collect()
    assert one.near_next == 1
    nulls = dg.compare_with_edits(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(nulls) == len(rows) and {r.id for r in nulls} == {None}
    assert len(dg.fingerprints(docs).collect()) == len(rows)
