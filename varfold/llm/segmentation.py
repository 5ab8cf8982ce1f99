"""SentencePiece encoding and decoding: segmentations sampled without replacement by Gumbel top-k.

A text's lattice holds every way to write it in pieces of the vocabulary; characters outside it become byte pieces. A
segmentation's probability is proportional to the product of its pieces' weights, which follow Zipf's law in the rank that
the model's scores give. No piece reaches across a space that follows another character, or across a line end, so the
lattice is a chain of small ones, built once for equal strings and kept up to a bound; backward sums of the weights turn it into
exact conditional probabilities.

The k segmentations with the largest Gumbel-perturbed log-probabilities are a sample without replacement. They are found
by an A* search over regions of the lattice: the best segmentation of a region is drawn from it by its conditional
probabilities, and what is left of the region falls into disjoint regions (same pieces up to a point, another piece
there), whose exact mass gives the law of their largest perturbed value, truncated at the value just taken. The region
with the largest value is next. All random numbers are hashes of the row key, the sample's number and the
place, and all sums run over a row's own pieces, so a row's samples and scores depend on nothing else, to the last bit. The
inclusion score of a sample is the probability that its value exceeds the (k + 1)-th largest value, given the latter:
1 - exp(-exp(log p - threshold)).

Decoding joins the pieces' bytes; every segmentation decodes to the text exactly.

Defined results: null text counts as empty; an empty text has one segmentation without pieces; a text with fewer than k
segmentations gives all of them, with inclusion 1; rows with equal keys and texts give equal samples; null keys count as
one key; empty tables give empty results; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varfold.llm.common import SpanHashes, blocks, span_hashes, table

#: Edges of lattices kept by a Python worker, beyond which those of parts not asked for again go; bytes of text sampled together.
KEPT_EDGES = 3_000_000
_TOGETHER = 1 << 19
#: Characters of new parts whose lattices are built together (a longer part is built alone), and pieces spelt together.
_BUILT, _SPELT = 1 << 15, 1 << 15
#: The factor (its logarithm) that lifts sums of weights for each character, and the longest rest of a part that is summed so.
_LIFT, _PLAIN = 3.0, 48
#: Rows of a long part's table that are lists at a time; parts so few are drawn one after the other.
_ROWS, _FEW = 4096, 4
#: Uniform numbers lie in 2**-53 to 1 - 2**-53, so none has a Gumbel value above this.
_HIGHEST = 36.75
_PARTS = re.compile(" *[^ \n]+| +|\n")
_ODD_SPACES = re.compile("  | \n| $|\0")
_U = np.uint64
#: In place of an id: no piece, but the beginning of one.
_BEGINS = -2


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id (a space stands for the space mark), their log-weights, and the ids of the 256 byte pieces."""

    ids: dict[str, int]
    log_weight: dict[int, float]
    byte_ids: tuple[int, ...]
    byte_log_weight: float
    size: int

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """Read a SentencePiece model file. The weight of a piece is 1 / (2 + rank), ranks by falling score."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i).replace("▁", " ") for i in plain}
        kept = [i for i in plain if text[i] and not re.search("[^ ] |\n", text[i])]
        ranks = {i: r for r, i in enumerate(sorted(kept, key=lambda i: (-sp.get_score(i), i)))}
        total = sum(1 / (2 + r) for r in ranks.values())
        log_weight = {i: float(-np.log((2 + r) * total)) for i, r in ranks.items()}
        byte_ids = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
        return cls({text[i]: i for i in kept}, log_weight, byte_ids, min(log_weight.values(), default=0.0), sp.vocab_size())

    def piece_bytes(self) -> list[bytes]:
        out = [b""] * self.size
        for piece, i in self.ids.items():
            out[i] = piece.encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return _to_unit(_mix(x))


def _to_unit(x: np.ndarray) -> np.ndarray:
    u = (x >> _U(12)).astype(np.float64)
    u += 0.5
    u *= 2.0**-52
    return u


def _again(seed: np.ndarray, factor: np.ndarray | np.uint64) -> np.ndarray:
    """Further numbers in (0, 1) from well-mixed seeds, one for each turn's factor."""
    x = seed * factor
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return _to_unit(x)


def _times(factor: np.uint64, n: int) -> np.uint64:
    return _U(int(factor) * n & (2**64 - 1))


_SAMPLE, _PLACE, _REGION = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x27D4EB2F165667C5)


def split_parts(text: str) -> list[str]:
    """The parts of a text: words with the spaces before them, line ends, and spaces that no word follows."""
    if _ODD_SPACES.search(text):
        return _PARTS.findall(text)
    return list(filter(None, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))


class Lattices:
    """The lattices of the distinct strings of texts, in flat arrays; those of a block of texts are built all at once."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary.ids), default=0)
        # Pieces and what pieces begin with: a span that is neither has no longer piece either, so its state is done.
        pieces = list(dict.fromkeys(p[:n] for p in vocabulary.ids for n in range(1, len(p) + 1)))
        data, starts, ends = _code_points(pieces)
        hashes = span_hashes(data, starts, ends)
        order = np.argsort(hashes, kind="stable")
        self._hashes = np.append(hashes[order], _U(0))
        self._ids = np.append(np.array([vocabulary.ids.get(p, _BEGINS) for p in pieces], np.int64)[order], -1)
        self._bucket = np.searchsorted(hashes[order] >> _U(44), np.arange((1 << 20) + 1, dtype=_U)).astype(np.int32)
        self._filled = np.diff(self._bucket).astype(np.int8)
        self._weight = np.full(vocabulary.size + 5, -np.inf)  # then those of one to four bytes; the last stands for no piece
        for i, w in vocabulary.log_weight.items():
            self._weight[i] = w
        self._weight[vocabulary.size : -1] = np.arange(1, 5) * vocabulary.byte_log_weight
        self._length = np.ones(vocabulary.size + 4)
        for p, i in vocabulary.ids.items():
            self._length[i] = len(p)
        # Sums of weights, each character lifted by a factor that keeps them near 1.
        self._lifted = np.exp(self._weight + _LIFT * np.concatenate((self._length, [0.0])))
        self.clear()

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; _BEGINS where pieces only begin so, -1 where none does."""
        bucket = (h >> _U(44)).astype(np.int32)
        filled, out = self._filled[bucket], np.full(len(h), -1, np.int32)
        some, j = np.flatnonzero(filled), 0
        while len(some):
            at = self._bucket[bucket[some]] + j
            hit = self._hashes[at] == h[some]
            out[some[hit]] = self._ids[at[hit]]
            j += 1
            some = some[~hit & (filled[some] > j)]
        return out

    def clear(self) -> None:
        self._number: dict[str, int] = {}
        self._states = self._edges = self._parts = 0
        #: By edge: ``next`` state (-1 at the part's end), ``symbol`` (a piece, or the vocabulary's size plus a code point that
        #: is written in bytes), ``log_p`` given the state (0 if it is the only edge), ``share`` (cumulative within the state).
        size = KEPT_EDGES + (KEPT_EDGES >> 2)
        self.next, self.symbol = np.empty(size, np.int32), np.empty(size, np.int32)
        self.log_p, self.share = np.empty(size), np.empty(size)
        #: By state: its first edge, one more at the end. By part: its first state, and whether it was asked for again.
        self.first, self._starts, self._again = np.zeros(size // 2, np.int64), np.empty(size // 8, np.int64), np.empty(size // 8, bool)
        self._sizes = {x: len(getattr(self, x)) for x in ("next", "symbol", "log_p", "share", "first", "_starts", "_again")}

    def _shrink(self) -> None:
        """Keep the parts that were asked for again; none where they have more than half the edges that may be kept."""
        again = self._again[: self._parts]
        kept, starts = np.flatnonzero(again), np.append(self._starts[: self._parts], self._states)
        state, states = starts[kept], starts[kept + 1] - starts[kept]
        edge, edges = self.first[state], self.first[state + states] - self.first[state]
        if 2 * edges.sum() > KEPT_EDGES:
            return self.clear()
        begins, at = np.cumsum(states) - states, _ranges(edge, edges)
        first = self.first[_ranges(state, states)] + np.repeat(np.cumsum(edges) - edges - edge, states)
        self._number = dict(zip(compress(self._number, again.tolist()), count()))
        next_ = self.next[at]
        next_ += np.where(next_ < 0, 0, np.repeat((begins - state).astype(np.int32), edges))
        self._replace("next", next_)
        for name in ("symbol", "log_p", "share"):  # one after the other, so that a single copy is held beside them
            self._replace(name, getattr(self, name)[at])
        for name, values in (("first", np.append(first, len(at))), ("_starts", begins), ("_again", np.zeros(len(kept), bool))):
            self._replace(name, values)
        self._parts, self._states, self._edges = len(kept), int(states.sum()), len(at)

    def _replace(self, name: str, values: np.ndarray) -> None:
        """``values`` instead of all there is, in an array no larger than ``clear`` makes it."""
        held = getattr(self, name)
        if len(held) > self._sizes[name]:
            setattr(self, name, np.empty(self._sizes[name], held.dtype))
        self._put(name, 0, values)

    def _put(self, name: str, begin: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        end = begin + len(values)
        if end > len(held):
            held = np.concatenate((held[:begin], np.empty(end + (end >> 1) - begin, held.dtype)))
            setattr(self, name, held)
        held[begin:end] = values

    def starts(self, parts: list[str]) -> np.ndarray:
        """The first state of each part. A state is a place in a distinct part; parts seen before are not built again."""
        if self._edges > KEPT_EDGES:
            self._shrink()
        numbers = np.fromiter(map(self._number.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(numbers < 0)
        self._again[numbers[numbers >= 0]] = True
        if len(missing):
            asked = [parts[i] for i in missing.tolist()]
            new = dict.fromkeys(asked)
            self._number.update(zip(new, count(len(self._number))))
            for together in _groups(list(new)):
                self._build(together)
            numbers[missing] = np.fromiter(map(self._number.__getitem__, asked), np.int64, len(asked))
        return self._starts[numbers]

    def _long_sums(self, part: np.ndarray, after: np.ndarray, begin: int, end: int) -> None:
        """``after`` (logarithms) of the places begin to end of one long part, from the last to the first; those from end on are known."""
        weight = self._weight.tolist()
        held = after[end : end + part.shape[1]].tolist()  # of the places that follow, the nearest first
        for at in range(end, begin, -_ROWS):
            low = max(at - _ROWS, begin)
            found = []
            for row in reversed(part[low:at].tolist()):
                values = [weight[s] + a for s, a in zip(row, held, strict=False) if s >= 0]
                top = max(values)
                value = top + math.log(sum([math.exp(v - top) for v in values]))
                found.append(value)
                held.insert(0, value)
                held.pop()
            after[low:at] = found[::-1]

    def _build(self, new: list[str]) -> None:
        data, starts, ends = _code_points(new)
        sizes, size = ends - starts, self.vocabulary.size
        places = _ranges(starts, sizes)
        left = np.repeat(ends, sizes) - places  # characters from a state to its part's end
        # A table of states and widths, the longest first, with the piece there is; one prefix sum gives the hashes of all spans.
        bits = max(self.longest - 1, 0).bit_length()
        table_ = np.full((len(places), 1 << bits), -1, np.int32)
        spans, row, widest = SpanHashes(data), np.arange(len(places)), np.ones(len(places), np.int64)
        for width in range(1, self.longest + 1):
            row = row[left[row] >= width]
            if not len(row):
                break
            at = places[row]
            found = self._look_up(spans.all(width)[at] if 2 * len(row) > len(data) else spans(at, at + width))
            piece = np.flatnonzero(found >= 0)
            table_[row[piece], -width] = found[piece]
            widest[row[piece]] = width
            row = row[found != -1]
        odd = np.flatnonzero(table_[:, -1] < 0)  # a character that is no piece becomes bytes
        code = data[places[odd]].astype(np.int64)
        table_[odd, -1] = size + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        # Backward sums, from the ends of all parts at once; where a part is too long for plain sums, their logarithms.
        plain, lift = np.zeros(len(places) + 1), self._lifted
        near = np.flatnonzero(left <= _PLAIN)
        level = left[near] * (_PLAIN + 1) + _PLAIN - widest[near]  # of a level, places with the widest pieces first
        order = near[np.argsort(level.astype(np.uint16), kind="stable")]
        wide = np.cumsum(np.bincount(level, minlength=(_PLAIN + 1) ** 2).reshape(-1, _PLAIN + 1), 1)
        end = 0
        for level, most in enumerate(wide[1:, ::-1].tolist(), 1):  # by width: how many places have a piece so wide or wider
            rows = order[end : end + most[0]]
            if not len(rows):
                break
            end += len(rows)
            deep, total = min(level, self.longest), np.zeros(len(rows))
            for w in (deep, *range(1, deep)):
                if most[w]:
                    some = rows[: most[w]]
                    total[: most[w]] += lift[table_[some, -w]] * (1.0 if w == level else plain[some + w])
            plain[rows] = total
        after = np.zeros(len(places) + 1)
        after[near] = np.log(plain[near]) - _LIFT * left[near]
        begins = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(sizes > _PLAIN).tolist():
            mine = slice(int(begins[k]), int(begins[k] + sizes[k]))
            self._long_sums(table_[mine, : -self.longest - 1 : -1], after[mine], 0, int(sizes[k]) - _PLAIN)
        flat = np.flatnonzero(table_.ravel() >= 0)
        source, width = flat >> bits, (1 << bits) - (flat & ((1 << bits) - 1))
        symbol = table_.ravel()[flat]
        counts = np.bincount(source, minlength=len(places))
        inside = width < left[source]
        target = source + width
        log_p = self._weight[symbol] + np.where(inside, after[np.minimum(target, len(places))], 0.0) - after[source]
        first = np.concatenate(([0], np.cumsum(counts)))
        symbol[first[1:][odd] - 1] = size + code
        log_p = np.where(counts[source] == 1, 0.0, np.minimum(log_p, -1e-17))
        share = np.exp(log_p)
        several, k = np.flatnonzero(counts > 1), 1
        while len(several):  # running sums within each state, whatever stands beside it
            at = first[several] + k
            share[at] += share[at - 1]
            k += 1
            several = several[counts[several] > k]
        share[first[1:] - 1] = 2.0  # the last edge takes what is left
        for name, values in (("next", np.where(inside, target + self._states, -1)), ("symbol", symbol), ("log_p", log_p), ("share", share)):
            self._put(name, self._edges, values)
        self._put("_starts", self._parts, begins + self._states)
        self._put("_again", self._parts, np.zeros(len(new), bool))
        self._put("first", self._states, first + self._edges)
        self._parts += len(new)
        self._states += len(places)
        self._edges += len(symbol)

    def pick(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge that each uniform number selects."""
        edge = self.first[state]
        on = np.flatnonzero(self.share[edge] < u)
        while len(on):
            edge[on] += 1
            on = on[self.share[edge[on]] < u[on]]
        return edge

    def walk(self, state: int, seed: np.uint64, turn: int) -> list[int]:
        """The edges from a state to its part's end, with the numbers of the turns from ``turn`` on; the same as ``pick`` turn by turn."""
        first, share, next_, out = self.first, self.share, self.next, []
        while state >= 0:
            turns = np.arange(turn, turn + 256, dtype=_U)
            for u in _again(np.full(256, seed), _PLACE * (_U(2) * turns + _U(1))).tolist():
                edge = int(first[state])
                while share[edge] < u:
                    edge += 1
                out.append(edge)
                state = int(next_[edge])
                if state < 0:
                    break
            turn += 256
        return out

    def expand(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, with the bounds of runs of symbols turned into bounds of runs of ids."""
        size, byte_ids = self.vocabulary.size, self.vocabulary.byte_ids
        odd = np.flatnonzero(symbols >= size)
        if not len(odd):
            return symbols.astype(np.int32), bounds
        distinct, which = np.unique(symbols[odd], return_inverse=True)
        spelt = [[byte_ids[b] for b in chr(c).encode("utf-8", "replace")] for c in (distinct - size).tolist()]
        counts = np.ones(len(symbols), np.int64)
        counts[odd] = np.array([len(x) for x in spelt])[which]
        ends = np.cumsum(counts)
        out = np.repeat(symbols, counts).astype(np.int32)
        flat = np.array([i for x in spelt for i in x], np.int32)
        begin = np.cumsum([len(x) for x in spelt]) - [len(x) for x in spelt]
        out[_ranges(ends[odd] - counts[odd], counts[odd])] = flat[_ranges(begin[which], counts[odd])]
        return out, np.concatenate(([0], ends))[bounds]


def _groups(parts: list[str]) -> Iterator[list[str]]:
    """The parts in their order, about _BUILT characters together."""
    begin = held = 0
    for i, part in enumerate(parts):
        if held and held + len(part) > _BUILT:
            yield parts[begin:i]
            begin, held = i, 0
        held += len(part)
    yield parts[begin:]


def _code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the strings in a row, one unused place after each, and where each begins and ends."""
    sizes = np.array([len(x) for x in strings], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    data = np.frombuffer("".join(x + "\0" for x in strings).encode("utf-32-le", "replace"), np.uint32)
    return data, ends - sizes, ends


@dataclass
class _Drawn:
    """One sample of each text that has one: its decisions in a row, and the regions that leave it."""

    bounds: np.ndarray  # by text: where its decisions begin; one more at the end
    edge: np.ndarray
    value: np.ndarray  # by text: perturbed log-probability, -inf where there is no sample
    from_: np.ndarray  # by text: the decision from which the sample left its parent
    out: dict  # by text: pieces taken out at that decision
    region: np.ndarray  # by text: the largest values of its regions in falling order, -inf beyond them
    where: np.ndarray  # the decisions at which these leave
    taken: np.ndarray  # by text: how many of them have been sampled


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), all in a row."""
    out = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    out += np.arange(len(out))
    return out


class Sampler:
    """Samples segmentations of several texts at once.

    A text's results are sums over its own decisions in their order, so they are the same to the last bit whatever texts stand beside it.
    """

    def __init__(self, lattices: Lattices, seed: int) -> None:
        self.lattices, self.seed = lattices, seed

    def sample(self, keys: list[int | None], texts: list[str], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text its samples in falling order of value: (ids, log-probability, value, inclusion)."""
        n, lat = len(texts), self.lattices
        lists = [split_parts(" " + t) if t else [] for t in texts]
        first = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
        starts = lat.starts([p for x in lists for p in x])
        key = _mix(np.array([(hash_key if hash_key is not None else 0x5EED) & (2**64 - 1) for hash_key in keys], _U) * _SAMPLE + _U(self.seed & (2**64 - 1)))
        has = np.diff(first) > 0
        root = np.where(has, -np.log(-np.log(_uniform(key ^ _REGION))), 0.0)
        drawn = [self._draw(0, k, key, first, starts, None, np.where(has, root, -np.inf))]
        for j in range(1, k + 1):
            best, whose = self._best(drawn)
            if j == k or not np.isfinite(best).any():
                break
            drawn.append(self._draw(j, k, key, first, starts, (drawn, whose), best))
        limit = self._best(drawn)[0]
        out: list[list] = [[] for _ in range(n)]
        for d in drawn:
            ids, bounds = lat.expand(lat.symbol[d.edge], d.bounds)
            log_p, some = np.zeros(n), np.flatnonzero(np.diff(d.bounds))
            if len(some):
                log_p[some] = np.add.reduceat(lat.log_p[d.edge], d.bounds[some])
            inclusion = -np.expm1(-np.exp(np.minimum(log_p - limit, 700.0)))
            for i in np.flatnonzero(np.isfinite(d.value)).tolist():
                out[i].append((ids[bounds[i] : bounds[i + 1]], float(log_p[i]), float(d.value[i]), float(inclusion[i])))
        for i in np.flatnonzero(~has).tolist():
            out[i] = [(np.empty(0, np.int32), 0.0, 0.0, 1.0)]
        return out

    @staticmethod
    def _best(drawn: list[_Drawn]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the open region of the largest value: the value and its sample."""
        tops = np.stack([d.region[np.arange(len(d.taken)), d.taken] for d in drawn])
        whose = tops.argmax(0)
        return tops[whose, np.arange(tops.shape[1])], whose

    def _turn(self, source: tuple, texts: np.ndarray, u: np.ndarray, edge: np.ndarray, rest: np.ndarray, head: np.ndarray, parts: np.ndarray) -> dict[int, list[int]]:
        """Take the best region of each text: the decisions kept (``head``) and the parts that they end (``parts``), the edge taken there
        instead, and the logarithm of the others' share (``rest``). Gives the edges taken out by text."""
        lat, outs = self.lattices, {}
        for s, d in enumerate(source[0]):
            mine = texts[source[1][texts] == s]
            at = d.where[mine, d.taken[mine]]
            d.taken[mine] += 1
            head[mine] = at - d.bounds[mine]
            ended = lat.next[d.edge[_ranges(d.bounds[mine], head[mine])]] < 0
            parts[mine] = np.bincount(np.repeat(np.arange(len(mine)), head[mine]), ended, len(mine))
            taken = d.edge[at]
            state = np.searchsorted(lat.first[: lat._states + 1], taken, side="right") - 1
            again = at == d.from_[mine]
            for i, e, low, high, same in zip(mine.tolist(), taken.tolist(), lat.first[state].tolist(), lat.first[state + 1].tolist(), again.tolist(), strict=True):
                gone = [e, *(d.out.get(i, []) if same else [])]
                edges = [x for x in range(low, high) if x not in gone]
                p = [math.exp(lat.log_p[x]) for x in edges]
                want, k = u[i] * sum(p), 0
                while k + 1 < len(p) and want > p[k]:
                    want -= p[k]
                    k += 1
                others = sum(p[:k] + p[k + 1 :])
                edge[i], rest[i], outs[i] = edges[k], math.log(others) if others > 0 else -np.inf, gone
        return outs

    def _draw(self, j: int, k: int, key: np.ndarray, first: np.ndarray, starts: np.ndarray, source: tuple | None, value: np.ndarray) -> _Drawn:
        """Sample number j of each text whose value is finite, from the best regions of ``source`` (or from everything)."""
        lat, n = self.lattices, len(key)
        texts = np.flatnonzero(np.isfinite(value))
        salt = key + _times(_SAMPLE, j + 1)
        head, parts, turned, turned_edge = (np.zeros(n, np.int64) for _ in range(4))
        rest, outs = np.full(n, -np.inf), {}
        part_from = first[:-1].copy()  # parts from here on are drawn anew
        tail = np.empty(0, np.int64)
        if source is not None:
            outs = self._turn(source, texts, _uniform(salt ^ _REGION), turned_edge, rest, head, parts)
            turned[texts] = 1
            part_from += parts
            tail = texts[lat.next[turned_edge[texts]] >= 0]
            part_from[np.setdiff1d(texts, tail)] += 1
        # Draw the parts anew, all at once: first what is left of the part in which the sample turned off.
        counts = np.zeros(n, np.int64)
        counts[texts] = (first[1:] - part_from)[texts]
        owner = np.repeat(np.arange(n), counts)
        part = _ranges(part_from, counts)
        state = starts[part]
        state[(np.cumsum(counts) - counts)[tail]] = lat.next[turned_edge[tail]]
        seed = _mix(salt[owner] + _PLACE * (part - first[owner]).astype(_U))
        turns: list[tuple[np.ndarray, np.ndarray]] = []
        lengths = np.zeros(len(part), np.int64)
        live, turn, walks = np.arange(len(part)), 0, {}
        while len(live) > _FEW:
            edge = lat.pick(state, _again(seed[live], _times(_PLACE, 2 * turn + 1)))
            turns.append((live, edge))
            lengths[live] += 1
            state = lat.next[edge]
            on = np.flatnonzero(state >= 0)
            live, state, turn = live[on], state[on], turn + 1
        for i, s in zip(live.tolist(), state.tolist(), strict=True):
            walks[i] = lat.walk(s, seed[i], turn)
            lengths[i] += len(walks[i])
        tail_count = np.bincount(owner, lengths, n).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(head + turned + tail_count)))
        edges = np.empty(int(bounds[-1]), np.int64)
        place = (bounds[:-1] + head + turned - (np.cumsum(tail_count) - tail_count))[owner] + np.cumsum(lengths) - lengths
        for t, (live, edge) in enumerate(turns):
            edges[place[live] + t] = edge
        for i, walk in walks.items():
            edges[place[i] + turn : place[i] + turn + len(walk)] = walk
        if source is not None:
            edges[bounds[texts] + head[texts]] = turned_edge[texts]
            for s, d in enumerate(source[0]):
                mine = texts[source[1][texts] == s]
                edges[_ranges(bounds[mine], head[mine])] = d.edge[_ranges(d.bounds[mine], head[mine])]
        region, where = self._regions(k, salt, bounds, edges, head, rest, source is not None, value)
        return _Drawn(bounds, edges, value, bounds[:-1] + head, outs, region, where, np.zeros(n, np.int64))

    def _regions(self, k: int, salt: np.ndarray, bounds: np.ndarray, edges: np.ndarray, head: np.ndarray, rest: np.ndarray, turned: bool, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k largest values of the regions that leave each sample at its turn or later, and their decisions.

        A region of log-mass m has the value m - log(exp(m - value) - log u), which rises with m - log(-log u); m is the
        log-probability of the decisions before it, which only falls, and more. So a text is done as soon as that and the largest
        Gumbel value together are below the k-th largest found.
        """
        lat, n = self.lattices, len(value)
        best, mass, noise, where = np.full((n, k), -np.inf), np.zeros((n, k)), np.ones((n, k)), np.zeros((n, k), np.int64)
        live, at, size, before = np.flatnonzero(np.diff(bounds)), 0, 32, np.zeros(n)
        while len(live):
            column = at + np.arange(size)
            here = bounds[live][:, None] + column
            beyond = here >= bounds[live + 1][:, None]
            log_p = lat.log_p[edges[np.where(beyond, bounds[live][:, None], here)]]
            log_p[beyond] = 0.0
            sums = np.cumsum(np.concatenate((before[live][:, None], log_p), 1), 1)
            least = best[live, -1]
            row, col = np.nonzero((log_p < 0) & (column >= head[live][:, None] + turned) & (sums[:, :-1] + _HIGHEST >= least[:, None]))
            u = _uniform(salt[live[row]] + _REGION * (column[col] + 1).astype(_U))
            # As -log u >= 1 - u, what is left out here can't be among the k largest.
            can = np.flatnonzero(1 - u <= np.exp(np.minimum(sums[row, col] - least[row], 1.0)) * (1 + 1e-9))
            row, col, u = row[can], col[can], u[can]
            m = sums[row, col] + np.log(-np.expm1(log_p[row, col]))
            if turned:
                own = np.flatnonzero((head[live] >= at) & (head[live] < at + size))
                m = np.append(m, sums[own, head[live[own]] - at] + rest[live[own]])
                row, col = np.append(row, own), np.append(col, head[live[own]] - at)
                u = np.append(u, _uniform(salt[live[own]] + _REGION * (head[live[own]] + 1).astype(_U)))
            x = -np.log(u)
            score = m - np.log(x)
            some = np.flatnonzero(score > least[row])
            mine = np.unique(row[some])  # of these texts what was found before and what is new, the best first
            old = np.repeat(mine, k)
            joined = [np.concatenate((kept[live[mine]].ravel(), fresh[some])) for kept, fresh in ((best, score), (mass, m), (noise, x), (where, here[row, col]))]
            order = np.lexsort((np.append(np.tile(np.arange(-k, 0), len(mine)), col[some]), -joined[0], owner := np.append(old, row[some])))
            counts = np.bincount(owner, minlength=len(live))[mine]
            top = order[_ranges(np.cumsum(counts) - counts, np.full(len(mine), k))].reshape(-1, k)
            for kept, values in zip((best, mass, noise, where), joined, strict=True):
                kept[live[mine]] = values[top]
            before[live] = sums[:, -1]
            at += size
            live = live[(bounds[live] + at < bounds[live + 1]) & (before[live] + _HIGHEST >= best[live, -1])]
            size = max(32, min(2 * size, (1 << 16) // max(len(live), 1)))
        some = np.isfinite(best)
        m, top = mass[some], np.repeat(value, k).reshape(n, k)[some]
        best[some] = m - np.log(np.exp(m - top) + noise[some])
        return best, where


def decode(ids: np.ndarray, piece_bytes: list[bytes]) -> str:
    """The text of a segmentation."""
    return b"".join(map(piece_bytes.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


class Spelling:
    """The bytes of all pieces in a row, to decode many segmentations at once."""

    def __init__(self, piece_bytes: list[bytes]) -> None:
        self._data = np.frombuffer(b"".join(piece_bytes), np.uint8)
        self._size = np.array([len(p) for p in piece_bytes], np.int64)
        self._start = np.cumsum(self._size) - self._size

    def equal(self, ids: np.ndarray, ends: np.ndarray, wanted: list[bytes]) -> list[bool]:
        """Whether the pieces of each segmentation (it ends at ``ends``) join to the bytes wanted."""
        size = self._size[ids]
        runs = (slice(i, i + _SPELT) for i in range(0, len(ids), _SPELT))
        made = b"".join([self._data[_ranges(self._start[ids[x]], size[x])].tobytes() for x in runs])
        bytes_to = np.concatenate(([0], np.cumsum(size)))[ends].tolist()
        return [made[a:b] == w for a, b, w in zip([0, *bytes_to], bytes_to, wanted, strict=False)]


_KEPT: dict[str, Lattices] = {}


def sample_segmentations(docs: DataFrame, model_file: str, k: int = 4, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, ids, n_pieces, log_prob, value, inclusion, round_trip): k distinct segmentations of each row's whole text.

    ids is binary, four bytes little-endian a piece. round_trip says that the pieces decode to the text. One pass, no shuffle.
    """
    vocabulary = Vocabulary.load(model_file)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "id long, rank int, ids binary, n_pieces long, log_prob double, value double, inclusion double, round_trip boolean"
    names = ["id", "rank", "ids", "n_pieces", "log_prob", "value", "inclusion", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _KEPT:
            _KEPT.clear()
            _KEPT[model_file] = Lattices(shared.value)
        sampler, spelt = Sampler(_KEPT[model_file], seed), Spelling(shared.value.piece_bytes())
        for batch in blocks(batches, 1, _TOGETHER):
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            found = sampler.sample(keys, texts, k)
            owner = [i for i, samples in enumerate(found) for _ in samples]
            rank = [r for samples in found for r in range(len(samples))]
            pieces, *numbers = zip(*[sample for samples in found for sample in samples], strict=True)
            sizes = np.array([len(x) for x in pieces], np.int64)
            flat, ends = np.concatenate(pieces).astype("<i4"), np.cumsum(sizes)
            wanted = [(" " + t if t else "").encode("utf-8", "replace") for t in texts]
            same = spelt.equal(flat, ends, [wanted[i] for i in owner])
            ids = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int32)), pa.py_buffer(flat)])
            columns = [pa.array([keys[i] for i in owner], pa.int64()), pa.array(rank, pa.int32()), ids, pa.array(sizes), *(pa.array(c, pa.float64()) for c in numbers), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def decode_segmentations(rows: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text of the ids in ``ids_col`` as one more column; a null stays null."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file).piece_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if b is None else decode(np.frombuffer(b, "<i4"), shared.value) for b in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, text_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{text_col}` string")


def default_model() -> str:
    """The public model this box offers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_segmentations(spark, sf_dir: str) -> DataFrame:
    """Four sampled segmentations of every document, as digests of their ids."""
    found = sample_segmentations(table(spark, sf_dir, "documents"), default_model())
    return found.select(F.col("id").alias("doc_id"), "rank", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), "log_prob", "value", "inclusion", "round_trip")
