"""Removal of repeated passages by relative Lempel-Ziv parsing over words.

Every text is parsed against all text that comes before it (smaller id, or earlier in the same text). A window is ``WINDOW``
consecutive words; a passage is a duplicate where each of its windows also starts earlier. The parse is in phrases. Each window
has an anchor: of its runs of GRAM words the one with the smallest hash, the first of equals. Consecutive windows with one anchor
are a phrase: its words follow from the text alone, so copies of a passage have the same phrases, wherever they stand.

1. Block by block (a few MB of text) phrases are indexed, and the block's texts are parsed greedily against this index: runs of
   phrases that occur earlier, at places that advance in step, are factors. Only the first occurrence in the block is left to others.
2. First occurrences meet by anchor in the index of all blocks, dealt by hashes. A phrase that stands earlier is part of a factor.
3. A factor ends where contexts part: there an anchor stands in several different phrases, whose windows may still
   be equal in part. These windows at factor boundaries, and no others, are compared one by one in the same two steps.

All this is exact up to collisions of 128 bits. A window that occurs earlier has the same anchor at the same place there. Either both are
in equal phrases, which step 1 or 2 finds, or their anchor has several phrases, and the first occurrences of these all
take part in step 3. Factors are a window or more, so shorter ones never count.

Phrases that recur are cut down in each block before they are shuffled, so a passage or line in a third of all texts sends a row a block. An
anchor that is frequent in a sample and stands in ever new contexts is dealt out by phrase, and its phrases all go to step 3. Long
texts are parsed in pieces that overlap by a window less a word, which has the same windows.

Defined results: null text has no words; a text shorter than a window loses nothing; rows equal in id and text are one document,
whose result is repeated for each; rows that share an id but not the text are documents in the order of a hash of their texts; null ids come last,
in that order too; an empty table gives an empty result; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varfold.llm.common import SharedTable, SpanHashes, blocks, table

#: Words of a window, and of the runs among which anchors are chosen.
WINDOW, GRAM = 20, 8
#: Bytes of text that a block indexes together; texts above it are parsed in pieces of that size.
BLOCK = 8 << 20
#: One document in SAMPLE shows which anchors are frequent: those that occur FREQUENT times there, at most HELD of them.
SAMPLE, FREQUENT, HELD = 64, 64, 1 << 16
#: Longer words are hashed apart; the others in pieces of so many bytes.
_LONG, _PIECE = 1 << 12, 1 << 20
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_MIX, _MORE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1
_NAMES = ["cell", "phrase", "spread", "doc", "sub", "start", "n", "ref_doc", "ref_sub", "ref_start"]
_SCHEMA = ", ".join(f"{c} {'boolean' if c == 'spread' else 'long'}" for c in _NAMES)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits of ``h``."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``."""
    space = np.concatenate(([True], _SPACE[data], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word."""
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > _LONG)
    for i in long:
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    for a, b in zip([0, *(long + 1)], [*long, len(starts)], strict=True):
        while a < b:
            c = max(a + 1, min(b, int(np.searchsorted(ends, starts[a] + _PIECE, side="right"))))
            out[a:c] = SpanHashes(data[starts[a] : ends[c - 1]])(starts[a:c] - starts[a], ends[a:c] - starts[a])
            a = c
    return out


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, by their start."""
    out = h[: max(len(h) - width + 1, 0)].copy()
    for i in range(1, width):
        out *= _MORE
        out += h[i : i + len(out)]
    return mixed(out)


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its smallest, the first of equals."""
    best, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = best[: len(best) - step], best[step:]
        best, size = np.where(values[b] < values[a], b, a), size + step
    return best


def phrases(words: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, n, anchor, phrase) of the phrases of texts whose words are hashed in ``words``, ``owner`` being the text of each:
    ``n`` windows from the word ``start`` on; phrase is a hash of all their words."""
    gram = min(GRAM, window)
    if len(words) < window:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
    whole = rolled(words, window)
    grams = rolled(mixed(words + _MORE), gram)
    at = first_least(grams, window - gram + 1)
    real = owner[: len(whole)] == owner[window - 1 :]
    new = real.copy()
    new[1:] &= ~real[:-1] | (at[1:] != at[:-1])
    start = np.flatnonzero(new)
    ends = np.flatnonzero(real & ~np.concatenate((real[1:] & ~new[1:], [False])))  # the last window of each
    n = ends - start + 1
    shape = (n * window + at[start] - start).astype(np.uint64)
    return start, n, grams[at[start]], mixed(whole[start] * _MORE + whole[ends] + mixed(shape))


def pieces_of(text: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    """The text in pieces of about BLOCK bytes, each with the number of its first word. They have each window once."""
    at, first, size = 0, 0, BLOCK
    while True:
        cut = _BREAK.search(text, at + size)
        end = cut.start() if cut else len(text)
        piece = text[at:end]
        if end == len(text):
            yield first, piece
            return
        starts, _ = word_bounds(np.frombuffer(piece, np.uint8))
        if len(starts) < window:  # words longer than a block
            size += BLOCK
            continue
        yield first, piece
        again = len(starts) - window + 1
        at, first, size = at + int(starts[again]), first + again, BLOCK


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts and the text of each."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = word_bounds(data)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return word_hashes(data, starts, ends), np.searchsorted(begin, starts, side="right") - 1


def factored(cell: np.ndarray, phrase: np.ndarray, spread: np.ndarray, doc: np.ndarray, sub: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a block, in the order of their places, parsed against the block: first occurrences, and factors that point to them."""
    order = np.argsort(mixed(cell) + phrase, kind="stable")
    c, p = cell[order], phrase[order]
    new = np.ones(len(order), bool)
    new[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1])
    ref = np.empty(len(order), np.int64)
    ref[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    first = ref == np.arange(len(ref))
    again = np.flatnonzero(~first & ((doc != doc[ref]) | (sub != sub[ref]) | (start != start[ref])))
    a, b = again[:-1], again[1:]
    in_step = (doc[a] == doc[b]) & (sub[a] == sub[b]) & (start[a] + n[a] == start[b])
    in_step &= (doc[ref[a]] == doc[ref[b]]) & (sub[ref[a]] == sub[ref[b]]) & (start[ref[b]] - start[ref[a]] == n[a])
    heads = np.flatnonzero(np.concatenate((np.ones(min(len(again), 1), bool), ~in_step)))
    lengths = np.add.reduceat(n[again], heads) if len(heads) else np.empty(0, np.int64)
    again = again[heads]
    columns = []
    for known, found in ((cell.view(np.int64), mixed(start[again].astype(np.uint64) + mixed(doc[again].view(np.uint64))).view(np.int64)), (phrase.view(np.int64), 0), (spread, False), (doc, doc[again]), (sub, sub[again]), (start, start[again]), (n, lengths)):
        columns.append(pa.array(np.concatenate((known[first], np.broadcast_to(found, len(again)).astype(known.dtype)))))
    none = np.arange(first.sum() + len(again)) < first.sum()
    for column in (doc, sub, start):
        columns.append(pa.array(np.concatenate((np.zeros(first.sum(), np.int64), column[ref[again]])), mask=none))
    yield pa.RecordBatch.from_arrays(columns, _NAMES)


def _placed(batch: pa.RecordBatch) -> list[int]:
    """Rows of a batch (doc, sub, ...) in order, each document once."""
    doc, sub = (batch.column(i).to_numpy() for i in (0, 1))
    order = np.lexsort((sub, doc))
    d, s = doc[order], sub[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return order[new].tolist()


def _grouped(batch: pa.RecordBatch, text: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, owner, row, first): hashed words of the batch's documents together, or of one piece of a long one; row and first by owner."""
    texts = batch.column(text)
    rows = _placed(batch)
    short = [i for i in rows if len(texts[i].as_buffer()) <= BLOCK]
    if short:
        yield *_joined([texts[i].as_py() for i in short]), np.array(short), np.zeros(len(short), np.int64)
    for i in sorted(set(rows) - set(short)):
        for first, piece in pieces_of(texts[i].as_py(), window):
            yield *_joined([piece]), np.array([i]), np.array([first])


def _phrase_rows(window: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 2, BLOCK):
            doc, sub = (batch.column(i).to_numpy() for i in (0, 1))
            for words, owner, row, first in _grouped(batch, 2, window):
                start, n, anchor, phrase = phrases(words, owner, window)
                own = owner[start]
                begin = np.searchsorted(owner, np.arange(len(row)))
                spread = np.isin(anchor, frequent)
                cell = np.where(spread, mixed(anchor + phrase), anchor)
                yield from factored(cell, phrase, spread, doc[row[own]], sub[row[own]], start - begin[own] + first[own], n)

    return run


def _window_rows(window: int):
    """Rows (doc, sub, text, starts, counts) come in; the windows from each start on are looked at one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 2, BLOCK):
            doc, sub = (batch.column(i).to_numpy() for i in (0, 1))
            sizes = batch.column(3).value_lengths().to_numpy()
            until = np.cumsum(sizes)
            starts, counts = (batch.column(i).flatten().to_numpy() for i in (3, 4))
            for words, owner, row, first in _grouped(batch, 2, window):
                whole, more = rolled(words, window), rolled(mixed(words + _MORE), window)
                begin = np.searchsorted(owner, np.arange(len(row) + 1))
                at, own = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for k, r in enumerate(row):
                    mine = slice(until[r] - sizes[r], until[r])
                    times = counts[mine]
                    place = np.repeat(starts[mine] - (np.cumsum(times) - times), times) + np.arange(times.sum()) - first[k]
                    place = np.unique(place[(place >= 0) & (place <= begin[k + 1] - begin[k] - window)])
                    at.append(place + begin[k])
                    own.append(np.full(len(place), k))
                at, own = np.concatenate(at), np.concatenate(own)
                yield from factored(whole[at], more[at], np.zeros(len(at), bool), doc[row[own]], sub[row[own]], at - begin[own] + first[own], np.ones(len(at), np.int64))

    return run


def _settled(rows: DataFrame) -> DataFrame:
    """(doc, sub, start, n, ref_doc, ref_sub, ref_start, open): factors found so far, and (open, without ref) the first occurrences of
    phrases whose cell has other phrases too."""
    place = F.struct("doc", "sub", "start")
    earliest = F.first(place).over(Window.partitionBy("cell", "phrase").orderBy("doc", "sub", "start"))
    cell = Window.partitionBy("cell")
    several = F.col("spread") | (F.min("phrase").over(cell) != F.max("phrase").over(cell))
    seen = rows.repartition("cell").withColumn("earliest", earliest).withColumn("several", several)
    known = F.col("ref_start").isNotNull()
    later = ~known & (F.col("earliest") != place)
    refs = [F.when(known, F.col(f"ref_{c}")).when(later, F.col(f"earliest.{c}")).alias(f"ref_{c}") for c in ("doc", "sub", "start")]
    return seen.where(known | later | F.col("several")).select("doc", "sub", "start", "n", *refs, (~known & ~later).alias("open"))


def _with_places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, sub, text): doc and sub are a document's place in the order; text is in UTF-8."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = rows.groupBy("id").agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | F.col("id").isNull())
    shared = SharedTable(shared.select("id"), "shared-ids").df
    print_ = F.xxhash64("text")
    sub: Column = F.lit(0).cast("long")
    if not shared.isEmpty():
        rows = rows.join(shared.where("id is not null").select("id", F.lit(True).alias("shared")), "id", "left")
        sub = F.when(F.col("id").isNull(), print_.bitwiseOR(F.lit(1))).when(F.col("shared"), print_.bitwiseAND(F.lit(-2))).otherwise(0)
    return rows.select("id", F.coalesce("id", F.lit(_LAST)).alias("doc"), sub.alias("sub"), F.col("text").cast("binary").alias("text"))


def _frequent(rows: DataFrame, window: int) -> np.ndarray:
    """Anchors that are frequent in a sample of documents, at most HELD: their phrases are dealt out. This only sets where rows meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 2, BLOCK):
            for words, owner, _, _ in _grouped(batch, 2, window):
                anchors, times = np.unique(phrases(words, owner, window)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(times)], ["anchor", "n"])

    sample = rows.where(F.pmod(F.xxhash64("doc", "sub"), F.lit(SAMPLE)) == 0).select("doc", "sub", "text")
    counts = sample.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    found = [r["anchor"] for r in counts.orderBy(F.desc("n"), "anchor").limit(HELD).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, sub, start, n, ref_doc, ref_sub, ref_start): ``n`` windows from the word ``start`` on that also stand from ref_start on in an
    earlier place. They cover every window that occurs earlier. doc and sub are as ``_with_places`` gives them."""
    return _factors(_with_places(docs, id_col, text_col), window)


def _factors(rows: DataFrame, window: int) -> DataFrame:
    inputs = rows.select("doc", "sub", "text")
    first = SharedTable(_settled(inputs.mapInArrow(_phrase_rows(window, _frequent(rows, window)), _SCHEMA)), "factors").df
    check = first.where("open").groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "n")).alias("s"))
    asked = inputs.join(check, ["doc", "sub"]).select("doc", "sub", "text", F.col("s.start").alias("starts"), F.col("s.n").alias("counts"))
    second = _settled(asked.mapInArrow(_window_rows(window), _SCHEMA))
    return first.unionByName(second).where("ref_start is not null").drop("open")


def merged(start: np.ndarray, n: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors in order, each taken as far as it goes: those whose places advance in step are one. ``refs`` has ref_doc, ref_sub and ref_start."""
    order = np.lexsort((-n, start))
    start, n, refs = start[order], n[order], refs[order]
    if len(start):
        keep = np.ones(len(start), bool)
        keep[1:] = start[1:] != start[:-1]
        start, n, refs = start[keep], n[keep], refs[keep]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1] + n[:-1]) | (refs[1:, :2] != refs[:-1, :2]).any(1) | (refs[1:, 2] - refs[:-1, 2] != n[:-1])
        heads = np.flatnonzero(new)
        start, n, refs = start[heads], np.add.reduceat(n, heads), refs[heads]
    return start, n, refs


def kept_words(text: bytes, start: np.ndarray, n: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """Words, removed words and the kept ones joined by a space, less those that the windows cover."""
    out, total, removed, at = [], 0, 0, 0
    until = np.sort(start + n + window - 1)
    start = np.sort(start)
    while at < len(text):
        cut = _BREAK.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        if len(start):
            place = np.arange(total, total + len(words))
            free = np.searchsorted(start, place, side="right") == np.searchsorted(until, place, side="right")
            kept = [w for w, f in zip(words, free.tolist(), strict=True) if f]
        else:
            kept = words
        if kept:
            out.append(b" ".join(kept))
        total, removed, at = total + len(words), removed + len(words) - len(kept), end
    return total, removed, b" ".join(out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept, factors) of each row of ``docs``: ``kept`` are the words outside all duplicate passages.

    ``factors`` are structs (start, words, ref_id, ref_start): ``words`` words from the word ``start`` on, which also stand from the word
    ref_start of the document ref_id on.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    rows = _with_places(docs, id_col, text_col)
    columns = ["start", "n", "ref_doc", "ref_sub", "ref_start"]
    found = _factors(rows, window).groupBy("doc", "sub").agg(F.collect_list(F.struct(*columns)).alias("f"))
    asked = rows.join(found, ["doc", "sub"], "left").select("id", "text", *[F.col(f"f.{c}").alias(c) for c in columns])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref_id", pa.int64()), ("ref_start", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1, BLOCK):
            sizes = batch.column(2).value_lengths().fill_null(0).to_numpy()
            until = np.cumsum(sizes)
            parts = [batch.column(i).flatten().to_numpy() for i in range(2, 7)]
            out, spans = [], []
            for i, text in enumerate(batch.column(1)):
                start, n, *refs = (p[until[i] - sizes[i] : until[i]] for p in parts)
                start, n, refs = merged(start, n, np.stack(refs, 1))
                out.append(kept_words(text.as_py(), start, n, window))
                spans.append([{"start": s, "words": k, "ref_id": None if r[0] == _LAST and r[1] & 1 else r[0], "ref_start": r[2]} for s, k, r in zip(start.tolist(), (n + window - 1).tolist(), refs.tolist(), strict=True)])
            total, removed, kept = zip(*out, strict=True)
            arrays = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_removed", "kept", "factors"])

    schema = "id long, n_words long, n_removed long, kept binary, factors array<struct<start: long, words: long, ref_id: long, ref_start: long>>"
    return asked.mapInArrow(run, schema).withColumn("kept", F.col("kept").cast("string"))


def op11_repeats(spark, sf_dir: str) -> DataFrame:
    """All documents less the words of repeated windows of 20 words."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB, window by window.
OP11_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, words, unnest(range(1, len(words) - 18)) as start from w),
windows as (select doc_id, start, array_to_string(words[start:start + 19], ' ') as run from s),
again as (select doc_id, start from (select doc_id, start, row_number() over (partition by run order by doc_id, start) as k from windows) where k > 1),
gone as (select distinct doc_id, unnest(range(start, start + 20)) as place from again),
placed as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from w),
kept as (select doc_id, count(*) as n_kept, string_agg(word, ' ' order by place) as words from placed anti join gone using (doc_id, place) group by doc_id)
select doc_id, cast(len(w.words) as bigint) as n_words, cast(len(w.words) - coalesce(n_kept, 0) as bigint) as n_removed,
  sha256(coalesce(kept.words, '')) as kept_sha256
from w left join kept using (doc_id)
"""
