"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

Candidates are the base matches (e-mail, IP, card, phone) and looser ones: e-mails written with (at) and (dot), phone
numbers without a plus, social security numbers, IBANs. Seven labelers vote yes, no or nothing on each: the strict
pattern, a checksum or structure, a gazetteer (top-level domains, calling codes, issuer prefixes, IBAN lengths, ranges
that are no one's address), words of context for and against, the shape of the digits, and the span's boundaries.

A latent-class model is fitted to the votes by expectation-maximisation: each labeler has a distribution of votes for
true and for false spans, each kind a share of true ones. Votes take few values, so the model is fitted to the counts of
vote patterns; these counts, and nothing else, reach the driver, and they cover all candidates. A logistic
classifier over votes, kind and shape is then trained on the posteriors. Base spans stay; other candidates are added
if the classifier gives them 0.5 or more and no base span overlaps them.

Positions are code points, ends exclusive. Defined results: null text counts as empty, and a text without candidates
gives empty lists; repeated rows are treated alike; without any candidate there is no model and nothing to decide;
empty tables give empty results; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varfold.llm.common import SharedTable, blocks, table

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
LABELERS = ("pattern", "structure", "gazetteer", "context_for", "context_against", "shape", "bounds")
#: Labelers whose silence comes from the kind of span and so is no evidence.
SILENT = ("pattern", "gazetteer")
#: Least probability of a span that isn't a base one.
ADD = 0.5

# The base patterns, in forms that give the same matches in time linear in the text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser candidates.
_SPELT = re.compile(r"\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]+)+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")

# Gazetteers.
_TLDS = frozenset("com org net edu gov mil int info biz io dev app ai co me us uk de fr es it nl be ch at se no dk fi pl pt cz gr ie ru ua tr in cn jp kr au nz ca mx br ar cl za eu".split())
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "354", "358", "420", "421", "971", "972")
_ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "36", "38", "30", "60", "65", "35", "62", "50", "56", "57", "58", "67")
_IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_FOR = {
    0: ("mail", "contact", "write to", "address", "correo", "courriel", "schreib"),
    1: ("ip", "server", "host", "from", "address", "client", "login"),
    2: ("card", "visa", "credit", "debit", "amex", "tarjeta", "carte", "karte", "payment"),
    3: ("phone", "call", "tel", "mobile", "cell", "fax", "contact", "reach", "teléfono", "whatsapp"),
    4: ("ssn", "social", "security"),
    5: ("iban", "account", "bank", "konto", "cuenta", "compte"),
}
_AGAINST = ("version", "isbn", "order", "invoice", "sku", "figure", "example", "serial", "build", "release", "page", "chapter", "part no")
_CONTEXT = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _left(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in _LOCAL_PART:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        floor = 0
        for m in _DOMAIN.finditer(text):
            start = _left(text, m.start(), floor)
            if start < m.start():
                out.append((start, 0, m.end()))
                floor = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= len(m[0]) <= 38:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the looser candidates."""
    out: list[tuple[int, int, int]] = []
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        for m in _SPELT.finditer(text):
            start = _left(text, m.start(), 0)
            if start < m.start():
                out.append((start, 0, m.end()))
    if _DIGIT.search(text):
        for kind, pattern in ((3, _LOCAL_PHONE), (4, _SSN), (5, _IBAN)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return out


def _structure(kind: int, span: str, digits: str) -> int:
    if kind == 0:
        return 1 if span[-1] != "-" and ".." not in span else -1
    if kind == 1:
        return 1 if all(p == (p.lstrip("0") or "0") for p in span.split(".")) else -1
    if kind == 2:
        return 1 if luhn(digits) else -1
    if kind == 3:
        return 1 if 9 <= len(digits) <= 15 and span.count("(") == span.count(")") else -1
    if kind == 4:
        return 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
    packed = span.replace(" ", "")
    return 1 if int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1 else -1


def _gazetteer(kind: int, span: str, digits: str) -> int:
    if kind == 0:
        return 1 if re.split(r"[^A-Za-z0-9-]", span.rstrip(")]"))[-1].lower() in _TLDS else -1
    if kind == 1:
        first, second = (int(p) for p in span.split(".")[:2])
        return -1 if first in (0, 10, 127) or first >= 224 or (first, second) in ((192, 168), (169, 254)) or (first == 172 and 16 <= second < 32) else 1
    if kind == 2:
        return 1 if digits.startswith(_ISSUERS) else -1
    if kind == 3:
        return 0 if span[0] != "+" else 1 if digits.startswith(_CALLING) else -1
    if kind == 5:
        return 1 if _IBAN_LENGTH.get(span[:2]) == len(span.replace(" ", "")) else -1
    return 0


def votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, int]:
    """The labelers' votes, each 0 to 2 (no, nothing, yes) as a digit to base 3, and the shape's code (0 to 15)."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    before = text[max(start - _CONTEXT, 0) : start].lower()
    around = text[start - 1 : start] + text[end : end + 1] if start else text[end : end + 1]
    given = (
        1 if base else 0,
        _structure(kind, span, digits),
        _gazetteer(kind, span, digits),
        1 if any(w in before for w in _FOR[kind]) else 0,
        -1 if any(w in before for w in _AGAINST) else 0,
        -1 if len(digits) > 5 and (len(set(digits)) < 3 or digits in "01234567890123456789") else 0,
        -1 if any(c.isalnum() or c in "_#$/=" for c in around) else 1,
    )
    code = 0
    for v in given:
        code = code * 3 + v + 1
    separators = sum(not c.isalnum() for c in span)
    return code, min(len(span) // 8, 3) * 4 + min(separators, 3)


_CANDIDATE = "array<struct<start:int,rank:int,end:int,base:boolean,votes:int,shape:int>>"
_SPAN = "array<struct<start:int,rank:int,end:int,base:boolean,probability:double>>"


def _nested(lists: list[list[tuple]], kinds: dict[str, pa.DataType]) -> pa.ListArray:
    flat = list(zip(*(x for one in lists for x in one), strict=True)) or [[] for _ in kinds]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(flat, kinds.values(), strict=True)], list(kinds)))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"start": pa.int32(), "rank": pa.int32(), "end": pa.int32(), "base": pa.bool_(), "votes": pa.int32(), "shape": pa.int32()}
    for batch in blocks(batches, 1):
        lists = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            found = [(*s, True) for s in base_spans(text)]
            found += [(*s, False) for s in loose_spans(text)]
            lists.append([(*s, *votes(text, *s)) for s in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), _nested(lists, kinds)], ["id", "candidates"])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, candidates) of each row of ``docs``: spans with their votes; one pass over whole texts, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_candidates, f"id long, candidates {_CANDIDATE}")


def _digits_of(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in range(len(LABELERS) - 1, -1, -1)], 1)


def reliabilities(rank: np.ndarray, codes: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted vote patterns.

    Returns the posterior of each pattern, P(vote | truth) as [labeler, truth, vote], and each kind's share of true spans.
    """
    v = _digits_of(codes)
    posterior = 1 / (1 + np.exp(-1.5 * (v - 1).sum(1)))  # the majority's view to begin with
    law, share = np.zeros((len(LABELERS), 2, 3)), np.zeros(len(KINDS))
    for _ in range(rounds):
        weight = np.stack([n * (1 - posterior), n * posterior])
        for k in range(len(KINDS)):
            mine = rank == k
            share[k] = (weight[1, mine].sum() + 1) / (n[mine].sum() + 2)
        for at, name in enumerate(LABELERS):
            for truth in (0, 1):
                law[at, truth] = np.bincount(v[:, at], weight[truth], 3) + ((0.5, 1, 1.5) if truth else (1.5, 1, 0.5))
                if name in SILENT:
                    law[at, truth, 1] = 0
                law[at, truth] /= law[at, truth].sum()
                if name in SILENT:
                    law[at, truth, 1] = 1
        ratio = np.log(law[:, 1] / law[:, 0])
        log = ratio[np.arange(len(LABELERS)), v].sum(1) + np.log(share[rank] / (1 - share[rank]))
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        moved, posterior = np.abs(new - posterior).max(initial=0), new
        if moved < 1e-9:
            break
    return posterior, law, share


def _design(rank: np.ndarray, codes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    parts = [np.eye(len(KINDS))[rank], np.eye(4)[shape // 4], np.eye(4)[shape % 4]]
    parts += [np.eye(3)[v][:, ::2] for v in _digits_of(codes).T]
    return np.concatenate([*parts, np.ones((len(rank), 1))], 1)


def fit_spans(found: DataFrame) -> np.ndarray | None:
    """Weights of the span classifier, from all candidates of ``candidates``; None if there are none."""
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.rank", "c.votes", "c.shape").count().collect()
    if not rows:
        return None
    rows.sort()
    rank, codes, shape, n = (np.array([r[i] for r in rows]) for i in range(4))
    posterior, _, _ = reliabilities(rank, codes, n.astype(float))
    x = _design(rank, codes, shape)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (posterior - p)) - w)
        w += step * min(1.0, 3 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def decide(found: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """(id, spans): base spans and the added ones with their probability, in order of start and kind."""
    kinds = {"start": pa.int32(), "rank": pa.int32(), "end": pa.int32(), "base": pa.bool_(), "probability": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for one in batch.column(1).to_pylist():
                if not one:
                    lists.append([])
                    continue
                x = _design(*(np.array([c[k] for c in one]) for k in ("rank", "votes", "shape")))
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                kept = [c for c in one if c["base"]]
                ends = np.maximum.accumulate([c["end"] for c in kept]) if kept else []
                starts = [c["start"] for c in kept]

                def clear(c: dict, starts=starts, ends=ends) -> bool:
                    before = np.searchsorted(starts, c["end"])
                    return not before or ends[before - 1] <= c["start"]

                good = [(c["start"], c["rank"], c["end"], c["base"], float(q)) for c, q in zip(one, p, strict=True) if c["base"] or (q >= ADD and clear(c))]
                lists.append(sorted(good))
            yield pa.RecordBatch.from_arrays([batch.column(0), _nested(lists, kinds)], ["id", "spans"])

    return found.mapInArrow(run, f"id long, spans {_SPAN}")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of each row of ``docs``: array<struct<start,rank,end,base,probability>>, rank an index of KINDS."""
    found = SharedTable(candidates(docs, id_col, text_col), "pii").df
    return decide(found, fit_spans(found))


def spans_text(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    found = find_pii(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    count = [F.expr(f"cast(size(filter(base, s -> s.rank = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select(F.col("id").alias("doc_id"), *count, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))
