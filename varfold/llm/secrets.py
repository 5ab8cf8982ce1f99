"""Secret scans in DataFrame functions only: base patterns, and sliding-window entropy over candidate strings.

Candidates are runs of 20 or more characters of a class (hexadecimal digits; the base64 alphabets). A window of
20 characters slides over each; the counts of its characters, and from them the Shannon entropy, are kept up to date by
one addition and one removal a step. Entropy is held as an integer, sum(round(c * log2(c) * 2**20)), so the result
depends on no order of additions. A candidate whose windows reach its class's entropy and mix of letters and digits
gives one span, from the first such window to the last, unless an allow-listed pattern matches the candidate or a base
span overlaps it.

Positions are code points, ends exclusive. They come from splitting the text at the matches: a match starts where the
pieces and matches before it end. Matches are summed and compared in chunks of about the square root of their number, and
texts are redacted a piece at a time, so time stays nearly in proportion to a text's length.

Defined results: null text counts as empty, and a text without spans gives empty lists and the SHA-256 of the empty
text; repeated rows are scanned alike; empty tables give empty results; columns other than the two named ones are
ignored by ``scan_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varfold.functions.names import unused_prefix
from varfold.llm.common import table

#: The base patterns, the kinds in their order.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters or more: shorter matches are dropped, and none can start inside them
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Code points of a text that are redacted at a time.
_PIECE = 4096
_SCALE = 1 << 20
_PART = [0, *(round(c * math.log2(c) * _SCALE) for c in range(1, WINDOW + 2))]
#: Bits of a count, which is at most WINDOW + 1, and counts in a long.
_WIDE, _COUNTERS = 5, 12
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name: the candidates' pattern, the alphabet, least entropy in bits, least digits, lower and upper case letters in a window, least letters of either case.
CLASSES = {
    "hex": (r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_=-])", _DIGITS + "abcdefABCDEF", 2.8, 4, 0, 0, 4),
    "base64": (r"[A-Za-z0-9+/_=-]{20,}", _DIGITS + _LOWER + _UPPER + "+/_=-", 3.5, 2, 2, 2, 0),
}
#: Candidates that are no secrets: stand-ins, runs of the alphabet, links, UUIDs, integrity digests.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|change_me|redacted|your[_-]|xxxx|0{8}|1{8}|0123456789|123456789|abcdefgh|qwerty|https?|www"
    r"|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^sha(1|256|384|512)[-=]"
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _in_chunks(items: Column) -> Column:
    """``items`` as arrays of about the square root of their number, so that what is done to each chunk stays cheap."""
    n = F.size(items)
    step = F.ceil(F.sqrt(n.cast("double"))).cast("int")
    return F.when(n > 0, _let(step, lambda k: F.transform(F.sequence(F.lit(0), ((n - 1) / k).cast("int")), lambda c: F.slice(items, c * k + 1, k)))).otherwise(F.array(items))


def _running(steps: Column) -> Column:
    """Running sums. Sums within chunks, then over chunks: an array that grows by each of its elements would be copied each time."""
    none = F.array().cast("array<int>")
    add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["ends"], F.array(s["at"] + x)).alias("ends"))
    sums = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("at"), none.alias("ends")), add, lambda s: s["ends"])
    shift = lambda own, offset: F.transform(own, lambda e: e + offset)
    before = lambda own: F.concat(F.array(F.lit(0)), sums(F.transform(own, lambda e: F.coalesce(F.get(e, F.size(e) - 1), F.lit(0)))))
    return _let(F.transform(_in_chunks(steps), sums), lambda own: F.flatten(F.zip_with(own, F.slice(before(own), 1, F.size(own)), shift)))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start,end,all,own>> of the matches; ``own`` is group 2 where the pattern has one."""

    def of(found: Column) -> Column:
        own = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern is ASSIGN else found
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda piece, match: F.length(piece) + F.length(match))
        zipped = _let(steps, lambda x: F.arrays_zip(_running(x).alias("end"), found.alias("all"), own.alias("own")))
        return F.transform(zipped, lambda z: F.struct((z["end"] - F.length(z["all"])).alias("start"), z["end"].alias("end"), z["all"].alias("all"), z["own"].alias("own")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _spans(places: Column, kind: str) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), p["end"].alias("end")))


def _if_found(text: Column, probe: str, spans: Column) -> Column:
    """Most texts have no match: one search settles those."""
    return F.when(text.rlike(probe), spans).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _dense(candidate: Column, alphabet: str, bits: float, digits: int, lower: int, upper: int, letters: int) -> Column:
    """struct<first,last> (code points in the candidate) of the windows that are dense enough; nulls if there are none."""
    part = F.array(*[F.lit(v) for v in _PART])
    most = int(WINDOW * (math.log2(WINDOW) - bits) * _SCALE)
    # Counts are kept _COUNTERS to a long, and those of digits, lower and upper case in one, so a step changes a few numbers.
    word = F.array(*[F.lit(k // _COUNTERS) for k in range(len(alphabet))])
    shift = F.array(*[F.lit(_WIDE * (k % _COUNTERS)) for k in range(len(alphabet))])
    one = F.array(*[F.lit(1 << (_WIDE * (k % _COUNTERS))).cast("long") for k in range(len(alphabet))])
    kind = F.array(*[F.lit(1 if c in _DIGITS else 1 << _WIDE if c in _LOWER else 1 << 2 * _WIDE if c in _UPPER else 0) for c in alphabet])
    low = (1 << _WIDE) - 1

    def count(counts: Column, c: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.get(counts, F.get(word, c)), F.get(shift, c)).bitwiseAND(F.lit(low)).cast("int")

    def move(s: Column, m: Column) -> Column:
        """The state after character ``m.into`` has come in and, from the second window on, ``m.out`` has gone."""
        had, lost = count(s["counts"], m["into"]), count(s["counts"], m["out"]) + (m["into"] == m["out"]).cast("int")
        gone = F.coalesce(F.get(part, lost - 1) - F.get(part, lost), F.lit(0))
        total = s["total"] + F.get(part, had + 1) - F.get(part, had) + gone
        nothing = F.lit(0).cast("long")
        change = lambda c, j: c + F.when(F.get(word, m["into"]) == j, F.get(one, m["into"])).otherwise(nothing) - F.when(F.get(word, m["out"]) == j, F.get(one, m["out"])).otherwise(nothing)
        mix = s["mix"] + F.get(kind, m["into"]) - F.coalesce(F.get(kind, m["out"]), F.lit(0))
        return F.struct(F.transform(s["counts"], change).alias("counts"), total.alias("total"), mix.alias("mix"), s["first"].alias("first"), s["last"].alias("last"))

    def judge(s: Column, i: Column) -> Column:
        d, lo, up = (F.shiftright(s["mix"], _WIDE * k).bitwiseAND(F.lit(low)) for k in range(3))
        good = (i >= WINDOW - 1) & (s["total"] <= most) & (d >= digits) & (lo >= lower) & (up >= upper) & (lo + up >= letters)
        first, last = F.coalesce(s["first"], F.when(good, i - WINDOW + 1)), F.when(good, i + 1).otherwise(s["last"])
        return F.struct(s["counts"].alias("counts"), s["total"].alias("total"), s["mix"].alias("mix"), first.alias("first"), last.alias("last"))

    def slide(at: Column) -> Column:
        out_of = lambda i: F.when(i >= WINDOW, F.get(at, i - WINDOW)).otherwise(-1)
        step = lambda s, i: _let(_let(F.struct(F.get(at, i).alias("into"), out_of(i).alias("out")), lambda m: move(s, m)), lambda t: judge(t, i))
        start = F.struct(
            F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // _COUNTERS)).alias("counts"),
            F.lit(0).alias("total"),
            F.lit(0).alias("mix"),
            F.lit(None).cast("int").alias("first"),
            F.lit(None).cast("int").alias("last"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return _let(F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c) - 1), slide)


def _entropy_spans(text: Column, name: str) -> Column:
    pattern, *rest = CLASSES[name]
    places = F.filter(_places(text, pattern), lambda p: ~p["all"].rlike(ALLOWED))
    found = F.transform(places, lambda p: F.struct(p["start"].alias("at"), _dense(p["all"], *rest).alias("dense")))
    some = F.filter(found, lambda p: p["dense"]["first"].isNotNull())
    spans = F.transform(some, lambda p: F.struct((p["at"] + p["dense"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("rank"), (p["at"] + p["dense"]["last"]).alias("end")))
    return _if_found(text, pattern, spans)


def with_secret_spans(rows: DataFrame, text_col: str, base: str = "base", spans: str = "spans") -> DataFrame:
    """``rows`` with two more columns, array<struct<start,rank,end>> in order: base spans, and all spans."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kinds = [
        _if_found(text, ASSIGN, _spans(F.filter(_places(text, ASSIGN), lambda p: F.length(p["own"]) >= 8), "assign")),
        _if_found(text, ACCESS, _spans(_places(text, ACCESS), "access")),
        _if_found(text, HEX, _spans(_places(text, HEX), "hex")),
    ]
    rows = rows.withColumn(base, F.array_sort(F.concat(*kinds)))
    found = rows.withColumn(spans, _distinct(F.array_sort(F.concat(*[_entropy_spans(text, name) for name in CLASSES]))))
    return found.withColumn(spans, F.array_sort(F.concat(F.col(base), _apart(F.col(spans), F.col(base)))))


def _distinct(ordered: Column) -> Column:
    """An ordered array without repeats."""
    return _let(ordered, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1))))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that no span of ``base`` overlaps. A chunk of ``base``, which is in order, is looked into only where its range overlaps."""
    over = lambda x, s: (x["start"] < s["end"]) & (s["start"] < x["end"])
    ranges = F.transform(
        _in_chunks(base), lambda c: F.struct(F.get(c, F.lit(0))["start"].alias("start"), F.array_max(F.transform(c, lambda x: x["end"])).alias("end"), c.alias("spans"))
    )
    free = _let(ranges, lambda cs: F.filter(spans, lambda s: ~F.exists(cs, lambda c: over(c, s) & F.exists(c["spans"], lambda x: over(x, s)))))
    return F.when((F.size(base) > 0) & (F.size(spans) > 0), free).otherwise(spans)


def spans_text(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of each row of ``docs``; spans are array<struct<start,rank,end>>, rank an index of KINDS."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return with_secret_spans(rows, "text").drop("text")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", chars_col: str | None = None) -> DataFrame:
    """``docs`` with each secret in the text replaced by ``mark``; overlapping spans are replaced as one.

    ``chars_col`` names a column that holds the text's length; it is set anew where the text has changed.
    """
    names, p = docs.columns, unused_prefix(docs)
    text, spans = F.col(f"`{text_col}`"), F.col(f"{p}spans")
    found = with_secret_spans(docs, text_col, f"{p}base", f"{p}spans")
    nearby = lambda low: F.filter(spans, lambda x: (x["start"] < low + _PIECE) & (x["end"] > low))

    def clean(piece: Column, number: Column) -> Column:
        """A piece of the text, from code point number * _PIECE on, with the parts of spans in it replaced."""
        low = number * _PIECE

        def cut(s: Column, x: Column) -> Column:
            kept = F.concat(s["out"], F.substring(piece, s["at"] - low + 1, x["start"] - s["at"]), F.lit(mark))
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], kept).otherwise(s["out"]).alias("out"))

        start = F.struct(low.alias("at"), F.lit("").alias("out"))
        # What a span covers beyond this piece is left out of the pieces that follow.
        return F.aggregate(nearby(low), start, cut, lambda s: F.concat(s["out"], F.substring(piece, s["at"] - low + 1, _PIECE)))

    hit = F.size(spans) > 0
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    out = found.withColumn(f"{p}clean", F.when(hit, F.array_join(F.transform(pieces, clean), "")).otherwise(text))
    replaced = {text_col: F.col(f"{p}clean")}
    if chars_col in names:
        replaced[chars_col] = F.when(hit, F.length(f"{p}clean").cast(docs.schema[chars_col].dataType)).otherwise(F.col(f"`{chars_col}`"))
    return out.select(*[replaced.get(n, F.col(f"`{n}`")).alias(n) for n in names])


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = [F.expr(f"cast(size(filter(base, s -> s.rank = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(F.col("id").alias("doc_id"), *count, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))
