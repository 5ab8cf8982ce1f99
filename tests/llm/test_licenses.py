"""License scans against brute-force containment."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from varfold.llm import licenses as li
from varfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def grams(text: str) -> list[tuple]:
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", lowered)
    return [tuple(words[i : i + li.SHINGLE]) for i in range(len(words) - li.SHINGLE + 1)]


def slow_licenses(text: str, least: float = li.CONTAINED) -> set[str]:
    out, found = set(), grams(text)
    places: dict[tuple, list[int]] = {}
    for i, g in enumerate(found):
        places.setdefault(g, []).append(i)
    for name, variants in li.TEMPLATES.items():
        for v in variants:
            want = grams(v)
            hits = sorted((i, g) for g in set(want) for i in places.get(g, []))
            reach = int(len(want) * 1.25) + 1
            for a, _ in hits:
                if len({g for i, g in hits if a <= i < a + reach}) >= least * len(set(want)):
                    out.add(name)
                    break
    return out


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(d, n) for d, t in texts.items() for n in slow_licenses(t)}
    got = QUERIES["op6_licenses"](spark, SF).collect()
    assert {(r.doc_id, r.license) for r in got} == want and len(got) == len(want) > 10
    for r in got:
        assert r.license in slow_licenses(" ".join(re.findall(r"\w+", texts[r.doc_id])[r.first_word : r.end_word])) or "_" in texts[r.doc_id]


def test_edited_notices_are_found(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    variants = [(n, v) for n, vs in li.TEMPLATES.items() for v in vs]
    for d in range(200):
        name, text = variants[d % len(variants)]
        words = text.split()
        for _ in range(len(words) // 25):
            words[rnd.randrange(len(words))] = "changed"
        filler = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randint(0, 90)))
        rows.append((d, f"{filler} {' '.join(words).upper() if d % 3 else ' '.join(words)}\n{filler}", "clash"))
        want[d] = slow_licenses(rows[-1][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got: dict[int, set] = {d: set() for d in want}
    for r in li.find_licenses(docs).collect():
        got[r.id].add(r.license)
    missed = sum(len(want[d] - got[d]) for d in want)
    assert all(got[d] <= want[d] for d in want)
    assert missed <= 2, [(d, want[d] - got[d]) for d in want if want[d] - got[d]]
    assert sum(len(w) for w in want.values()) > 150


def test_hard_rows(spark):
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, mit), (4, ("word " * 150_000) + mit), (None, mit), (3, mit), (5, f"{mit} {mit}\n{mit}"), (6, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.id), r.license) for r in li.find_licenses(docs).collect())
    assert got == sorted([(i, "MIT") for i in ("3", "3", "4", "None", "5", "5", "5")])
    assert li.find_licenses(docs.where(F.lit(False))).collect() == []
