"""Source divergence audit: how far the word shares of the sources of a language are from each other and from the language's.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the terms that enough of its
documents hold. A group (language and source) with ``n`` occurrences of a term out of ``size`` has the smoothed share
1 + floor(10**9 * (n + 5) / (size + 5 * vocabulary)); everything is exact integer arithmetic.

The distance of two groups is the sum of abs(p - q) over all kept terms. It is never computed term by term for all pairs, but
by inclusion and exclusion over the terms that a group has (its support). Write p0 and q0 for the shares of absent terms:

* a group's counts form a histogram (count, number of terms); each of its rows is priced once against another group's q0,
  which gives the sum of abs(p - q0) over the support, and the other way round;
* terms in both supports were priced twice. Postings (language, term, group) joined with themselves on the term give these
  pairs, and each is corrected by abs(p - q) - abs(p - q0) - abs(p0 - q) + abs(p0 - q0);
* terms in neither support are constants: (vocabulary - support - other support) * abs(p0 - q0).

Texts are read once and counted in the tasks that read them; counts are shuffled in place of words. No list of a group's
terms, of a term's groups or of pairs is gathered in one place. What grows with the square of the number of sources is the result.

Defined results: null texts, languages and sources count as empty strings; a group without kept terms has distances as any
other (0 where the language keeps no term) and no terms; repeated rows count again; ties are settled by the item; texts of any
length are whole; an empty table gives an empty result; columns other than the three named ones are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varfold.llm.common import SharedTable, blocks, table

#: Documents of a language that must hold a term, and distinct terms of a group that are reported.
LEAST_DOCS, TERMS = 30, 50
#: Shares are counted in units of one in SCALE, after PRIOR occurrences are added to each term.
SCALE, PRIOR = 1_000_000_000, 5
#: Distinct (group, term) pairs that a task counts before it hands its counts on.
HELD = 1 << 18
#: Bytes of a long text that are cut into words at a time, and groups that others are paired with in one unit.
PIECE, UNIT = 1 << 20, 1024

#: Letters lower-cased, bytes of characters beyond ASCII as they are, all else a space.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 0x20 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size."""
    plain, at = text.translate(_TERM_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) come in; (lang, source, term, n, docs) go out, and a row without a term for each group."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = [None, *n]
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary())]
            columns += [pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        counts.clear()

    for batch in blocks(batches, 2):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in terms_of(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(n) for n, _ in counts.values()) > HELD:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and documents that hold it; a null term for each group."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(*named, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    found = found.withColumn("term", F.col("term").cast("string"))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, size: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (size + PRIOR * vocabulary)), exact for any long; null for an empty vocabulary."""
    wide = "decimal(38,0)"
    over = (n + PRIOR).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = size.cast(wide) + (vocabulary * PRIOR).cast("decimal(19,0)")
    return F.when(vocabulary > 0, F.call_function("div", over.cast(wide), under.cast(wide)) + 1)


def _pairs(groups: DataFrame, units: int) -> DataFrame:
    """(lang, source, zero, terms, item, other_zero, other_terms, vocabulary) of each two groups of a language, dealt by units of others."""
    mine = groups.select("lang", "source", "zero", "terms", "vocabulary", F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("terms").alias("other_terms"), F.pmod(F.xxhash64("source"), F.lit(units)).cast("int").alias("unit"))
    return mine.join(others, ["lang", "unit"]).where("source <> item").drop("unit")


def divergences(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part "pair" has each other source of the language and its distance, part "term"
    the terms that the source uses most beyond the language's share, to rank ``terms``. Ranks fall with the value."""
    counts = SharedTable(term_counts(docs, lang_col, source_col, text_col), "terms").df
    known = counts.where(F.col("term").isNotNull())
    kept = known.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = SharedTable(kept.select("lang", "term", "total"), "kept-terms").df
    postings = SharedTable(known.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "postings").df

    langs = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_size"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("terms"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["size", "terms", "vocabulary", "lang_size"])
    groups = SharedTable(groups.withColumn("zero", share(F.lit(0), F.col("size"), F.col("vocabulary"))), "groups").df

    # One-sided terms by histograms: a row a count that occurs in a group, at most the square root of twice its size.
    histogram = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(groups.select("lang", "source", "size", "vocabulary"), ["lang", "source"])
    histogram = histogram.select("lang", "source", share(F.col("n"), F.col("size"), F.col("vocabulary")).alias("p"), "times")
    pairs = SharedTable(_pairs(groups, max(1, -(-groups.count() // UNIT))), "pairs").df
    priced = histogram.join(pairs.select("lang", "source", "item", "other_zero"), ["lang", "source"])
    one_sided = priced.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other_zero")) * F.col("times")).alias("value"))

    # Terms of both by postings; each two groups once.
    p = share(F.col("n"), F.col("size"), F.col("vocabulary")).alias("p")
    q = share(F.col("total"), F.col("lang_size"), F.col("vocabulary")).alias("q")
    shares = SharedTable(postings.join(groups, ["lang", "source"]).select("lang", "source", "term", p, q, "zero"), "shares").df
    a, b = shares.select("lang", "term", "source", "p", "zero"), shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"))
    both = a.join(b, ["lang", "term"]).where("source < item")
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    correction = gap("p", "other_p") - gap("p", "other_zero") - gap("zero", "other_p") + gap("zero", "other_zero")
    overlap = both.groupBy("lang", "source", "item").agg(F.sum(correction).alias("value"))

    neither = pairs.select("lang", "source", "item", F.coalesce((F.col("vocabulary") - F.col("terms") - F.col("other_terms")) * gap("zero", "other_zero"), F.lit(0)).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    overlap = SharedTable(overlap, "overlaps").df
    one_sided = SharedTable(one_sided, "one-sided").df
    parts = neither.unionByName(one_sided).unionByName(turned(one_sided)).unionByName(overlap).unionByName(turned(overlap))
    distances = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked(distances, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= terms))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    """Distances of all sources of each language, and the terms that mark them, over all documents."""
    return divergences(table(spark, sf_dir, "documents"))


#: The same in DuckDB, term by term for all pairs.
OP12_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
groups as (select distinct lang, source from d),
t as (select doc_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as raw from d),
low as (select doc_id, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from t),
kept as (select lang, term, count(*) as total from low group by lang, term having count(distinct doc_id) >= 30),
langs as (select lang, count(*) as v, sum(total) as n from kept group by lang),
c as (select lang, source, term, count(*) as n from low join kept using (lang, term) group by lang, source, term),
sizes as (select g.lang, g.source, coalesce(sum(c.n), 0) as size from groups g left join c using (lang, source) group by g.lang, g.source),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
  cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (s.size + 5 * l.v) as bigint) as p,
  cast(1 + (1000000000::hugeint * (k.total + 5)) // (l.n + 5 * l.v) as bigint) as q
  from sizes s join kept k using (lang) join langs l using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item from groups a join groups b on a.lang = b.lang and a.source <> b.source),
far as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select lang, source, 'pair' as part, item, cast(coalesce(value, 0) as bigint) as value from pairs left join far using (lang, source, item)),
term as (select lang, source, 'term' as part, term as item, p - q as value from p where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
  from (select * from pair union all select * from term))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
