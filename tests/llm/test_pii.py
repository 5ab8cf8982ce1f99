"""Personal data against brute force, and the weak-supervision model."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from varfold.llm import pii
from varfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def slow_luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])) % 10 == 0


def slow_base(text: str) -> list[tuple[int, int, int]]:
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(CARD, text) if 12 <= len(digits(m[0])) <= 19 and slow_luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def as_text(spans) -> str:
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(11)
    texts = ["a@b.c@d.e", "@x@b.c", "@a.b@c.d", "x@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "+1 (555) 123-4567x", "4111-1111 1111 1111", "é+49 30 1234567..", "a@b", "..@..", "+1+12345678901"]
    texts += ["".join(rnd.choice("0123456789@@..-- +()aZ%_é") for _ in range(rnd.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(rnd.choice(["0", "4111 1111 1111 1111", "a@b.co", "1.2.3.", "+", " ", "-"]) for _ in range(12)) for _ in range(1000)]
    for t in texts:
        assert pii.base_spans(t) == slow_base(t), t


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_pii"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = slow_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(as_text(base).encode()).hexdigest()
        assert set(as_text(base).split(",")) <= set(r.spans.split(",")) or not base


def test_added_spans(spark):
    texts = [f"please call 415-555-{i:04d} or write to jane.doe{i} (at) somefirm (dot) com, ssn 123-45-{6000 + i}" for i in range(40)]
    texts += [f"order 415-555-{i:04d}x part no 000-00-000{i % 10} user@host{i}.com and 8.8.4.{i} +1 202 555 01{i:02d}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.spans for r in pii.find_pii(docs).collect()}
    for i in range(40):
        kinds = {(pii.KINDS[s["rank"]], texts[i][s["start"] : s["end"]]) for s in got[i]}
        assert kinds == {("phone", f"415-555-{i:04d}"), ("email", f"jane.doe{i} (at) somefirm (dot) com"), ("ssn", f"123-45-{6000 + i}")}
        assert all(s["base"] for s in got[40 + i]) and len(got[40 + i]) == 3


def test_expectation_maximisation_finds_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.6
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.9, 0.6, 0.85])
    votes = np.where(rng.random((4000, 7)) < right, truth[:, None], ~truth[:, None]) * 2
    codes = (votes * 3 ** np.arange(6, -1, -1)).sum(1)
    known, n = np.unique(codes, return_counts=True)
    posterior, reliability, share = pii.reliabilities(np.zeros(len(known), int), known, n.astype(float))
    assert np.abs(reliability[:, 1, 2] - right).max() < 0.05 and abs(share[0] - 0.6) < 0.05
    assert ((posterior[np.searchsorted(known, codes)] > 0.5) == truth).mean() > 0.97


def test_hard_rows(spark):
    texts = [None, "", "1" * 100_000, "a" * 100_000 + "@", "1.1." * 20_000, "a@b.co " * 5000, "\U0001f600 x@y.zz"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a@b.co", ""), (6, texts[6], "")], "doc_id long, text string, spans string")
    for r in pii.find_pii(docs).collect():
        want = slow_base(texts[r.id] or "") if r.id not in (None, 2, 3, 4) else {None: [(0, 0, 6)]}.get(r.id)
        if want is not None:
            assert [(s["start"], s["rank"], s["end"]) for s in r.spans] == want
    assert pii.find_pii(docs.where(F.lit(False))).collect() == []
    assert [r.spans for r in pii.find_pii(docs.where("doc_id < 2")).collect()] == [[], []]
