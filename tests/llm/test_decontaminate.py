"""Benchmark decontamination against plain dynamic programming."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from varfold.llm import decontaminate as dc
from varfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_distance(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to a substring."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


def test_myers_equals_dynamic_programming():
    rnd = random.Random(4)
    for _ in range(300):
        pattern = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90)))
        text = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) + pattern[rnd.randint(0, 9) :] + "".join(rnd.choice("abc") for _ in range(9))
        distance, end = dc.myers(dc.masks(pattern), len(pattern), text)
        assert distance == slow_distance(pattern, text)
        assert distance == slow_distance(pattern, text[:end])


def edited(rnd: random.Random, text: str, edits: int) -> str:
    for _ in range(edits):
        at = rnd.randrange(len(text))
        text = rnd.choice([text[:at] + "q" + text[at:], text[:at] + text[at + 1 :], text[:at] + "q" + text[at + 1 :]])
    return text


def test_finds_all_within_budget_and_nothing_else(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(6, 60)))) for i in range(25)]
    docs, want = [], set()
    for d in range(120):
        text, k = " ".join(word() for _ in range(60)), rnd.randrange(25)
        n = len(items[k][1])
        if d % 2:
            edits = rnd.choice([0, int(n * 0.05), int(n * 0.05) + 6])
            text += " " + edited(rnd, items[k][1], edits).upper() + "\n\n " + word()
        docs.append((d, text))
        want |= {(d, i) for i, t in items if slow_distance(t, dc.normalise(text)) <= int(len(t) * dc.ERROR_RATE)}
    frame = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item_id string")
    got = dc.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.id, r.item) for r in got} == want and len(got) == len(want) > 20
    texts, by_item = dict(docs), dict(items)
    for r in got:
        assert slow_distance(by_item[r.item], dc.normalise(texts[r.id])) == r.distance
        assert slow_distance(by_item[r.item], dc.normalise(texts[r.id])[r.start : r.end]) == r.distance
    left = dc.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == frame.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_of_items_and_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 150)
    item = "the quick brown fox jumps over the lazy dog again and again"
    items = spark.createDataFrame([(1, item), (2, None), (3, "short"), (None, item), (4, "unrelated words that never occur in any document at all")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 60_000 + item + " y" * 60_000), (None, item), (3, item), (5, "short")], "doc_id long, text string")
    got = sorted((str(r.id), str(r.item), r.distance) for r in dc.find_leaks(docs, items).collect())
    assert got == sorted([("5", "3", 0), *((d, i, 0) for d in ("3", "3", "None") for i in ("1", "None"))])
    assert sorted(str(r.doc_id) for r in dc.drop_contaminated(docs, items).collect()) == ["1", "2"]
    assert dc.find_leaks(docs.limit(0), items).collect() == []
    assert dc.find_leaks(docs, items.limit(0)).collect() == []
    assert dc.drop_contaminated(docs, items.limit(0)).count() == 6


def test_short_items_are_whole_words(spark):
    """Items of 1 to 23 characters against a regular expression; two in one place, at the ends, with other characters than letters."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abé1") for _ in range(rnd.randint(1, 3)))
    items = [(n, " ".join(word() for _ in range(9))[:n].strip()) for n in range(1, 24)] + [(30, "a"), (31, "+a"), (32, "b é"), (33, "  "), (34, "")]
    texts = [" ".join(word() + rnd.choice(["", ",", "+a"]) for _ in range(40)) + " " + items[i % 23][1].upper() for i in range(60)]
    want = set()
    for d, text in enumerate(texts):
        whole = dc.normalise(text)
        for i, item in items:
            t = dc.normalise(item)
            places = [m.start() for m in re.finditer(f"(?={re.escape(t)})", whole)] if t else []
            inside = lambda at: 0 < at < len(whole) and whole[at - 1].isalnum() and whole[at].isalnum()  # noqa: B023, E731
            places = [p for p in places if not inside(p) and not inside(p + len(t))]
            if places:
                want.add((d, i, 0, places[0], places[0] + len(t)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dc.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 60


def test_short_and_long_items_together():
    long = "a long item with an edit in it that stands beside short ones in one text"
    matcher = dc.Matcher([(1, long), (2, "one"), (3, "stand"), (4, long.replace("edit", "word")), (5, "text")])
    assert [m[:2] for m in matcher.find(f"One {long} here")] == [(1, 0), (2, 0), (5, 0)]
    assert [m[:2] for m in matcher.find(long.replace("item", "itm") + " one")] == [(1, 1), (2, 0), (5, 0)]


def test_repeated_items_share_a_block(spark, monkeypatch):
    item = "one item that ten thousand rows of the benchmark repeat"
    monkeypatch.setattr(dc, "BLOCK_CHARS", 100)
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.lit(item).alias("text"))
    assert [len(b) for b in dc._item_blocks(items, "text")] == [1]
    docs = spark.createDataFrame([(1, item + "."), (2, "clean")], "doc_id long, text string")
    assert dc.find_leaks(docs, items).count() == 10_000
    assert [r.doc_id for r in dc.drop_contaminated(docs, items).collect()] == [2]


def test_query(spark):
    texts = {r.doc_id: dc.normalise(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: dc.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, b in items.items() if b in t}
    got = QUERIES["op10_decontaminate"](spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.distance == 0} == want


def test_documents_are_read_once_whatever_the_blocks(spark, monkeypatch, tmp_path):
    """Thirty blocks are run over each task's documents in turn; the plan scans the documents once and has no item in it."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    items = [(i, " ".join(word() for _ in range(10))) for i in range(60)]
    docs = [(d, " ".join([word(), *(items[i][1] for i in rnd.sample(range(60), d % 4)), word()])) for d in range(80)]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    frame, of = spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "BLOCK_CHARS", 170)
    assert len(list(dc._item_blocks(of, "text"))) == 30
    found = dc.find_leaks(frame, of)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not any(x in plan for _, x in items) and len(plan) < 10_000
    got = found.collect()
    assert {(r.id, r.item) for r in got} == want and len(got) == len(want) > 60
    assert {r.doc_id for r in dc.drop_contaminated(frame, of).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert all("_value" not in b.__dict__ for b in dc._Blocks(spark, dc._numbered(of, "text")).shared)
