"""Near-duplicate removal against all pairs' exact Jaccard indices."""

from __future__ import annotations

import random
import re

import pytest

from varfold.llm import simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text: str | None) -> set:
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def kept_ids(rows: list[tuple]) -> list[int]:
    """The smallest id of each component, from all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 10 * common >= 8 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def texts() -> list[str]:
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    line, out = " ".join(word() for _ in range(12)), []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([20, 60, 200]))]
        out.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.05):  # indices from about 0.95 to 0.5
            near = [w if rnd.random() > share else word() for w in base]
            out += [" ".join(near), " ".join(near[: len(near) * 9 // 10])]
    for _ in range(30):  # unlike texts with a line in common
        out.append(" ".join([line, *(word() for _ in range(40)), line]))
    base = [word() for _ in range(150)]
    for k in range(40):  # one large group
        out.append(" ".join(base[:k] + [word()] + base[k + 1 :]))
    for _ in range(5):  # equal sets but for a few shingles, which a majority over repeats takes for far apart
        prose = " ".join(word() for _ in range(150))
        out += [f"{prose} {line}", f"{prose} {' '.join([line] * 200)}"]
    out += ["one", "ONE", "one two three four five six", "one two three four five", "", None]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("cell_rows", [8, 4096])
def test_kept_documents_equal_all_pairs(spark, monkeypatch, cell_rows):
    from varfold.llm import jaccard

    monkeypatch.setattr(jaccard, "CELL_ROWS", cell_rows)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == kept_ids(rows)


def test_simhash_links_are_taken_first(spark):
    """Near copies within the grid's bits are candidates of its own, and what it finds is verified."""
    from varfold.llm import jaccard

    rows = list(enumerate(texts()))
    prints = jaccard._prints(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, 800)
    nodes = prints.groupBy("fp").agg({"sim": "min"}).withColumnRenamed("min(sim)", "sim")
    of = {r.fp: r.sim for r in nodes.collect()}
    pairs = {(r.u, r.v) for r in jaccard._simhash_pairs(nodes).collect()}
    near = {(a, b) for a in of for b in of if a < b and ((of[a] ^ of[b]) & (1 << 64) - 1).bit_count() <= jaccard.BITS}
    root = {f: f for f in of}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    assert len(near) > 40 and all(find(a) == find(b) for a, b in near)
    assert {find(a) for a, _ in pairs} <= {find(a) for a, _ in near}


def test_table_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == kept_ids(rows)


def test_sets_that_share_a_hash_are_told_apart(spark):
    from varfold.llm import jaccard

    rows = [(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 5), (5, 8, 5)]
    got = {r.id: r.fp for r in jaccard._told_apart(spark.createDataFrame(rows, "id long, fp long, other long")).collect()}
    assert got[1] == got[3] != got[2] and got[4] == got[5] == 8 and len(set(got.values())) == 3


def test_single_cells_go_whatever_the_batches():
    import pyarrow as pa

    from varfold.llm import jaccard

    rnd = random.Random(2)
    cells = sorted(rnd.choice(range(60)) for _ in range(70))
    lone = next(c for c in cells if cells.count(c) == 1)
    for size in (1, 2, 3, 7, 100):
        columns = lambda i, j: [pa.array(cells[i:j], pa.int64()), *(pa.array(range(i, j), pa.int64()) for _ in range(3)), pa.array([c == lone for c in cells[i:j]])]
        batches = [pa.RecordBatch.from_arrays(columns(i, min(i + size, 70)), ["cell", "fp", "n", "rest", "frequent"]) for i in range(0, 70, size)]
        batches.insert(1, batches[0].slice(0, 0))
        got = [r for b in jaccard._shared(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert got == [(c, i, i, i) for i, c in enumerate(cells) if cells.count(c) > 1 or c == lone]


def test_marks_bound_what_sets_have_in_common():
    import numpy as np

    from varfold.llm import jaccard

    rng = np.random.default_rng(4)
    tight = []
    for n, m, common in [(1, 1, 0), (1, 1, 1), (5, 400, 5), (60, 70, 0), (64, 65, 60), (500, 520, 450), (500, 520, 0), (4000, 3300, 3300), (0, 7, 0), (0, 0, 0)]:
        whole = np.unique(rng.integers(0, 1 << 63, n + m, np.uint64))
        a, b = np.sort(whole[:n]), np.sort(whole[n - common : n - common + m])
        marks = jaccard.mark(a), jaccard.mark(b)
        assert all(len(x) >= max(8, len(s) // 4) for x, s in zip(marks, (a, b), strict=True))
        bound = jaccard.most_common(*marks, n, m)
        assert common <= bound == jaccard.most_common(*marks[::-1], m, n) <= min(n, m)
        tight.append((bound - common) / max(min(n, m), 1))
    assert tight[6] < 0.6 and tight[5] < 0.1  # unlike sets fall, and like ones are told closely


def test_sets_of_many_pairs_are_dealt_out(spark, monkeypatch):
    """A set that half of all pairs have goes to several partitions, and each pair keeps both its ends."""
    from varfold.llm import jaccard
    from varfold.llm.common import SharedTable

    monkeypatch.setattr(jaccard, "SPLIT", 10)
    pairs = {(0, v) for v in range(1, 400)} | {(u, 500) for u in range(300)} | {(7, 9), (500, 600)}
    frame = SharedTable(spark.createDataFrame(sorted(pairs), "u long, v long"), "test-pairs").df
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(700)], "fp long, text string")
    out = jaccard._with_ends(frame, rows)
    got = [tuple(r) for r in out.select("u", "v", "a_text", "b_text").collect()]
    assert len(got) == len(pairs) and set(got) == {(u, v, f"t{u}", f"t{v}") for u, v in pairs}
    parts = out.rdd.mapPartitions(lambda rs: [sum(r.v == 500 for r in rs)]).collect()
    assert max(parts) < 150 and sum(n > 0 for n in parts) > 5


def test_each_set_keeps_its_best_pair(spark):
    from varfold.llm import jaccard

    rows = [(1, 2, 900), (1, 3, 950), (2, 3, 850), (4, 5, 800), (1, 6, 810), (6, 7, 810)]
    got = {tuple(r) for r in jaccard._best(spark.createDataFrame(rows, "u long, v long, score long")).collect()}
    assert got == {(1, 3), (1, 2), (4, 5), (1, 6), (6, 7)}
