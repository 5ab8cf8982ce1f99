"""Benchmark decontamination: pigeonhole edit matching of test items against whole documents.

Items and texts are compared in lower case with white space collapsed to one space. An item of n characters has an
error budget of e = floor(n * ERROR_RATE) edits and is split into e + 1 pieces: in any occurrence within the budget at
least one piece is untouched. An Aho-Corasick automaton finds all exact piece hits in one pass over a text; hits that
point to the same place of the same item share one window, and each window is verified with Myers's bit-parallel edit
distance (semi-global; one bit a character of the item).

Items shorter than WHOLE_WORDS characters have no budget and must stand between other characters than letters and digits
(or at an end), so that "art" is not found in "part".

The items are the stated query set. Their distinct texts are numbered in a shared table and go to the executors in blocks of a bounded
number of characters; the driver holds one block at a time. Documents are read once: a task takes some megabytes of text and runs the blocks over
them in turn, holding one automaton. Ids are joined to what was found, so repeated items cost nothing twice.

Defined results: null text counts as empty and matches nothing; items that are null or empty after normalising are left
out; repeated items and rows each give their own rows; empty tables give empty results; columns other than the named
ones are ignored, or kept by ``drop_contaminated``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varfold.llm.common import SharedTable, blocks, table

ERROR_RATE = 0.05
#: Shorter items are found as they are, as whole words.
WHOLE_WORDS = 24
#: Characters of distinct items in one block (at least one item each); this bounds what is collected and broadcast at a time.
BLOCK_CHARS = 4_000_000
#: Bytes of text that a task holds while it runs several blocks over them, each of which is built for that.
HELD_BYTES = 64 << 20


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any substring of ``text``, and the first end at which it occurs."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best, best_end = full, 0, size, size, 0
    for end, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv
        if score < best:
            best, best_end = score, end
    return best, best_end


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether a match neither begins nor ends inside a word."""
    within = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not within(start) and not within(end)


@dataclass
class _Item:
    key: int | None
    text: str
    budget: int
    forward: dict[str, int]
    backward: dict[str, int]


class Matcher:
    """The automaton and masks of one block of items (id, text)."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = ERROR_RATE) -> None:
        self.items: list[_Item] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for key, raw in items:
            text = normalise(raw)
            if not text:
                continue
            budget = int(len(text) * rate) if len(text) >= WHOLE_WORDS else 0
            for offset, piece in pieces(text, budget):
                places.setdefault(piece, []).append((len(self.items), offset))
            self.items.append(_Item(key, text, budget, masks(text), masks(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None, first_only: bool = False) -> list[tuple[int | None, int, int, int]]:
        """(item, distance, start, end) of the best occurrence (least distance, then leftmost) of each item within its budget.

        Positions are in the normalised text.
        """
        text = normalise(text)
        if not self.items or not text:
            return []
        points: dict[int, list[int]] = {}
        exact: dict[int, int] = {}
        for last, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                if len(self.items[k].text) >= WHOLE_WORDS:
                    points.setdefault(k, []).append(last + 1 - size - offset)
                elif k not in exact and _stands_alone(text, last + 1 - size, last + 1):
                    exact[k] = last + 1 - size
        out = []
        for k in sorted(points.keys() | exact.keys()):
            item, best = self.items[k], None
            if k in exact:
                out.append((item.key, 0, exact[k], exact[k] + len(item.text)))
                if first_only:
                    break
                continue
            e, n = item.budget, len(item.text)
            windows: list[list[int]] = []
            for at in sorted(points[k]):
                a, b = max(at - e, 0), min(at + n + e, len(text))
                if windows and a <= windows[-1][1] and at - windows[-1][2] <= 2 * e:
                    windows[-1][1:] = [b, at]
                else:
                    windows.append([a, b, at])
            for a, b, _ in windows:
                window = text[a:b]
                same = window.find(item.text)
                if same >= 0:
                    found = (0, a + same, a + same + n)
                else:
                    distance, end = myers(item.forward, n, window)
                    if distance > e:
                        continue
                    _, back = myers(item.backward, n, window[max(end - n - distance, 0) : end][::-1])
                    found = (distance, a + end - back, a + end)
                if best is None or found < best:
                    best = found
            if best is not None:
                out.append((item.key, *best))
                if first_only:
                    break
        return out


def _numbered(items: DataFrame, text_col: str) -> DataFrame:
    """(number, text) of the distinct texts, in a shared table."""
    texts = items.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct()
    return SharedTable(texts.select(F.monotonically_increasing_id().alias("number"), "text"), "items").df


def _item_blocks(items: DataFrame, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Distinct texts with their numbers, in blocks of BLOCK_CHARS; the driver holds one block and one partition at a time."""
    numbered = items if "number" in items.columns else _numbered(items, text_col)
    block, chars = [], 0
    for row in numbered.toLocalIterator():
        if block and chars + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row["number"], row["text"]))
        chars += len(row["text"])
    if block:
        yield block


_BUILT: dict[str, Matcher] = {}


class _Blocks:
    """Blocks of items as broadcast variables, which the driver keeps on disk, and their matchers in a task."""

    def __init__(self, spark, numbered: DataFrame) -> None:
        self.id = uuid.uuid4().hex
        self.shared = [spark.sparkContext.broadcast(block) for block in _item_blocks(numbered, "text")]

    def matchers(self) -> Iterator[Matcher]:
        """One at a time; a single one is built once in each Python worker."""
        if len(self.shared) == 1:
            if self.id not in _BUILT:
                _BUILT.clear()
                _BUILT[self.id] = Matcher(self.shared[0].value)
            yield _BUILT[self.id]
            return
        for block in self.shared:
            yield Matcher(block.value)
            block.__dict__.pop("_value", None)  # a worker that has read a block would keep it

    def batches(self, batches: Iterator[pa.RecordBatch], text: int | str) -> Iterator[pa.RecordBatch]:
        """The batches in parts that a task holds together."""
        limit = {} if len(self.shared) == 1 else {"limit": HELD_BYTES}
        yield from (part for batch in batches for part in blocks([batch], text, **limit))


def _pairs(items: _Blocks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items.batches(batches, 1):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [(d, *m) for matcher in items.matchers() for d, t in zip(ids, texts, strict=True) for m in matcher.find(t)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["id", "number", "distance", "start", "end"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, distance, start, end): the best occurrence of each item in each document, within the item's budget."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    numbered = _numbered(items, item_text_col)
    ids = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).join(numbered, "text").select("number", "item")
    hits = rows.mapInArrow(_pairs(_Blocks(docs.sparkSession, numbered)), "id long, number long, distance int, start int, end int")
    return hits.join(ids, "number").select("id", "item", "distance", "start", "end")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item occurs within its budget, all columns kept."""
    known = _Blocks(docs.sparkSession, _numbered(items, item_text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in known.batches(batches, text_col):
            for matcher in known.matchers():
                part = part.filter(pa.array([not matcher.find(t, first_only=True) for t in part.column(text_col).to_pylist()], pa.bool_()))
            yield part

    return docs.mapInArrow(run, docs.schema)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", "start", "end")
