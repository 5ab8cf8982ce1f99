"""Sampled segmentations against the enumerated lattice."""

from __future__ import annotations

import math
import time
from collections import Counter

import duckdb
import numpy as np
import pytest

from varfold.llm import segmentation as sg
from varfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tiny() -> sg.Vocabulary:
    pieces = ["a", "b", "ab", "aba", " ", " a", " ab", "ba", "c"]
    weights = {i: math.log(w) for i, w in enumerate([0.2, 0.1, 0.3, 0.05, 0.1, 0.2, 0.1, 0.15, 0.2])}
    return sg.Vocabulary({p: i for i, p in enumerate(pieces)}, weights, tuple(range(20, 276)), math.log(0.01), 276)


def enumerate_all(v: sg.Vocabulary, text: str) -> dict[tuple, float]:
    """Every segmentation with its probability."""
    out: dict[tuple, float] = {}

    def go(rest: str, ids: tuple, weight: float) -> None:
        if not rest:
            out[ids] = math.exp(weight)
            return
        for p, i in v.ids.items():
            if rest.startswith(p):
                go(rest[len(p) :], (*ids, i), weight + v.log_weight[i])
        if rest[0] not in v.ids:
            raw = rest[0].encode()
            go(rest[1:], ids + tuple(v.byte_ids[b] for b in raw), weight + len(raw) * v.byte_log_weight)

    go(" " + text if text else "", (), 0.0)
    total = sum(out.values())
    return {k: p / total for k, p in out.items()}


@pytest.mark.parametrize("text", ["abab", "ab aba", "aé\nab", "c", ""])
def test_all_segmentations_come_once_with_their_probability(text):
    v = tiny()
    want = enumerate_all(v, text)
    (found,) = sg.Sampler(sg.Lattices(v), 1).sample([7], [text], len(want) + 3)
    got = {tuple(ids.tolist()): p for ids, p, _, _ in found}
    assert got.keys() == want.keys() and len(found) == len(want)
    assert all(abs(math.exp(p) - want[k]) < 1e-9 for k, p in got.items())
    values = [x[2] for x in found]
    assert values == sorted(values, reverse=True)
    assert all(x[3] == 1.0 for x in found)


def test_law_of_the_samples():
    """First samples follow the probabilities; pairs follow sampling without replacement; weights are unbiased."""
    v, text, n = tiny(), "abab ab", 6000
    want = enumerate_all(v, text)
    found = sg.Sampler(sg.Lattices(v), 5).sample(list(range(n)), [text] * n, 3)
    firsts = Counter(tuple(f[0][0].tolist()) for f in found)
    chi = sum((firsts[k] - n * p) ** 2 / (n * p) for k, p in want.items() if n * p > 5)
    cells = sum(n * p > 5 for p in want.values())
    assert chi < cells + 5 * math.sqrt(2 * cells)
    top = sorted(want, key=want.get)[-2:]
    pair = want[top[0]] * want[top[1]] / (1 - want[top[0]])
    seen = sum([tuple(x[0].tolist()) for x in f[:2]] == list(top) for f in found)
    assert abs(seen - n * pair) < 5 * math.sqrt(n * pair) + 5
    # Sum of p / inclusion over the sample estimates 1, and the mean number of pieces is estimated without bias.
    estimate = np.array([sum(math.exp(p) / q * len(ids) for ids, p, _, q in f) for f in found])
    mean = sum(p * len(k) for k, p in want.items())
    assert abs(estimate.mean() - mean) < 5 * estimate.std() / math.sqrt(n)
    values = np.array([f[0][2] for f in found])
    assert abs(values.mean() - 0.57722) < 5 * 1.2825 / math.sqrt(n)


def test_samples_depend_on_the_key_only():
    v = tiny()
    sampler = sg.Sampler(sg.Lattices(v), 3)
    texts = ["abab " * 30, "", "ab", "c c c\n", "é" * 40 + " ab" * 9]
    together = sampler.sample([1, 2, 3, None, 5], texts, 3)
    alone = [sg.Sampler(sg.Lattices(v), 3).sample([k], [t], 3)[0] for k, t in zip([1, 2, 3, None, 5], texts, strict=True)]
    for a, b in zip(together, alone, strict=True):
        assert [(x[0].tolist(), round(x[2], 9)) for x in a] == [(x[0].tolist(), round(x[2], 9)) for x in b]
    assert [x[0].tolist() for x in together[0]] != [x[0].tolist() for x in sampler.sample([9], texts[:1], 3)[0]]
    for text, found in zip(texts, together, strict=True):
        spelt = v.piece_bytes()
        assert len({tuple(x[0].tolist()) for x in found}) == len(found)
        assert all(sg.decode(x[0], spelt) == text for x in found)


def exact(found) -> list:
    return [[(ids.tobytes(), log_p.hex(), value.hex(), inclusion.hex()) for ids, log_p, value, inclusion in f] for f in found]


def test_results_are_the_same_to_the_last_bit_in_any_block():
    """One block, blocks of seven, single rows; warm and cold lattices; lattices built in another order."""
    frame = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id limit 120").fetchall()
    frame += [(900, "x" * 700), (901, "ab cd " * 300), (902, ""), (903, "\n" * 500), (904, "日本語の文章です。" * 40), (905, "zq" * 60 + " \U0001f600 end")]
    keys, texts = map(list, zip(*frame, strict=True))
    vocabulary = sg.Vocabulary.load(sg.default_model())
    warm = sg.Lattices(vocabulary)
    whole = exact(sg.Sampler(warm, 0).sample(keys, texts, 4))
    assert exact(sg.Sampler(warm, 0).sample(keys, texts, 4)) == whole
    sampler = sg.Sampler(sg.Lattices(vocabulary), 0)
    sevens = [x for i in range(0, len(keys), 7) for x in exact(sampler.sample(keys[i : i + 7], texts[i : i + 7], 4))]
    assert sevens == whole
    for lattices in (warm, sg.Lattices(vocabulary)):
        single = [exact(sg.Sampler(lattices, 0).sample([k], [t], 4))[0] for k, t in reversed(frame)][::-1]
        assert single == whole
    for i in range(0, len(keys), 15):
        lattices = sg.Lattices(vocabulary)
        assert exact(sg.Sampler(lattices, 0).sample([keys[i]], [texts[i]], 4))[0] == whole[i]


def test_pruned_regions_never_win():
    """The search that stops early gives what a search over every decision gives."""
    v, keys = tiny(), list(range(60))
    texts = ["abab aba c " * (i % 9) + "ab" * (i % 5) for i in keys]
    found = exact(sg.Sampler(sg.Lattices(v), 2).sample(keys, texts, 4))
    whole, sg._HIGHEST = sg._HIGHEST, 1e9
    try:
        assert exact(sg.Sampler(sg.Lattices(v), 2).sample(keys, texts, 4)) == found
    finally:
        sg._HIGHEST = whole


def test_parts():
    for text in ["", " a b", " a  b", " a\n\nb c\n", " a \n b", " a ", "\0 x\0y z", " \n", " é\t\u3000 b\r\n"]:
        assert sg.split_parts(text) == sg._PARTS.findall(text)


def test_long_runs_take_time_in_proportion():
    sampler = sg.Sampler(sg.Lattices(sg.Vocabulary.load(sg.default_model())), 0)
    began = time.perf_counter()
    (found,) = sampler.sample([1], ["themeinerationst" * 16_000], 4)
    assert len(found) == 4 and time.perf_counter() - began < 30


def test_hard_rows_and_round_trip(spark):
    texts = [None, "", " ", "\n", "a▁b ▁", "  two  spaces ", "x" * 100_000, "word " * 20_000, "\U0001f600 é\t\r\n", "<s> <0x41> </s>"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "one", "c"), (3, "\n", "c")], "doc_id long, text string, ids string")
    found = sg.sample_segmentations(docs, sg.default_model(), 3)
    rows = sg.decode_segmentations(found, sg.default_model()).collect()
    assert all(r.round_trip for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert {r.id for r in rows} == {*range(10), None}
    for i, t in enumerate(texts):
        assert all(r.text == (t or "") for r in by[i])
        assert len({bytes(r.ids) for r in by[i]}) == len({r.rank for r in by[i]})
        assert len({r.rank for r in by[i]}) == 3 or i not in (5, 6, 7, 9)
    assert len(by[3]) % 2 == 0
    assert sg.sample_segmentations(docs.limit(0), sg.default_model()).collect() == []


def test_query(spark):
    got = QUERIES["op2_segmentations"](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(got) == 4 * n and all(r.round_trip for r in got)
    assert len({(r.doc_id, r.ids_sha256) for r in got}) == 4 * n
    assert all(0 < r.inclusion <= 1 for r in got)
