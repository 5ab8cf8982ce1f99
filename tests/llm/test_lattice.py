"""Lattices hold just the pieces there are, look up no span that no piece begins with, and take bounded memory."""

from __future__ import annotations

import tracemalloc

import numpy as np

from varfold.llm import segmentation as sg
from varfold.llm.segmentation import Lattices, Sampler, Spelling, Vocabulary, default_model


def test_spans_that_begin_no_piece_are_not_looked_up(monkeypatch):
    vocabulary = Vocabulary.load(default_model())
    lattices, seen, look_up = Lattices(vocabulary), [], Lattices._look_up

    def watched(self, h):
        seen.append(len(h))
        return look_up(self, h)

    monkeypatch.setattr(Lattices, "_look_up", watched)
    rng = np.random.default_rng(3)
    parts = [" " + "".join(rng.choice(list("qxzjkvwQXZ0123456789é名"), 40)) for _ in range(50)] + [" international", " the", " constitutionality", "\n"]
    starts = lattices.starts(parts)
    every = sum(min(lattices.longest, len(p) - i) for p in parts for i in range(len(p)))
    assert sum(seen) < every / 2
    for part, start in zip(parts, starts.tolist(), strict=True):
        for i in range(len(part)):
            first, end = lattices.first[start + i], lattices.first[start + i + 1]
            got = lattices.symbol[first:end].tolist()
            want = [vocabulary.ids[part[i:j]] for j in range(len(part), i, -1) if part[i:j] in vocabulary.ids]
            if part[i] not in vocabulary.ids:
                want.append(vocabulary.size + ord(part[i]))
            assert got == want


def lattice(lattices: Lattices, part: str) -> list[tuple]:
    """By place: pieces, places they lead to, log-probabilities and shares."""
    start, out = int(lattices.starts([part])[0]), []
    for state in range(start, start + len(part)):
        x = slice(*lattices.first[state : state + 2].tolist())
        next_ = [n - start if n >= 0 else None for n in lattices.next[x].tolist()]
        out.append((lattices.symbol[x].tolist(), next_, lattices.log_p[x].tolist(), lattices.share[x].tolist()))
    return out


def test_parts_asked_for_again_stay_when_others_go(monkeypatch):
    monkeypatch.setattr(sg, "KEPT_EDGES", 3000)
    vocabulary = Vocabulary.load(default_model())
    lattices, fresh = Lattices(vocabulary), Lattices(vocabulary)
    often, rare = [" the", " international", "\n", "é名" * 40, " x" + "ab" * 60], [f" rare{i}word" for i in range(300)]
    for i in range(0, 300, 20):
        lattices.starts([*often, *rare[i : i + 20]])
    assert set(often) <= set(lattices._number) and len(lattices._number) < 300 and lattices._edges < 5000
    assert list(lattices._number.values()) == list(range(lattices._parts))
    for part in [*often, *rare[::-29], *list(lattices._number)[:20]]:
        assert lattice(lattices, part) == lattice(fresh, part)
    before = lattices._parts
    lattices.starts(rare)
    lattices.starts(rare)  # now too many were asked for again, so none is kept
    assert lattices._parts == 300 > before - len(often)
    assert lattice(lattices, often[3]) == lattice(fresh, often[3])


def test_memory_of_a_worker_is_bounded():
    """All of it, with blocks of new words that overflow what is kept: a worker held over 500 MB, so two of them broke an executor."""
    rng = np.random.default_rng(5)
    letters = np.array(list("etaoinshrdlucm"))
    texts = [[" ".join("".join(w) for w in rng.choice(letters, (sg._TOGETHER // 80, 7)).tolist()) for _ in range(10)] for _ in range(4)]
    vocabulary = Vocabulary.load(default_model())
    tracemalloc.start()
    try:
        lattices, spelling = Lattices(vocabulary), Spelling(vocabulary.piece_bytes())
        for block in texts:
            found = Sampler(lattices, 0).sample(list(range(10)), block, 4)
            pieces = [s[0] for f in found for s in f]
            wanted = [(" " + t).encode() for t, f in zip(block, found, strict=True) for _ in f]
            assert all(spelling.equal(np.concatenate(pieces), np.cumsum([len(p) for p in pieces]), wanted))
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert most < 320


class Counted(np.ndarray):
    """An array that counts what is taken from it by index."""

    taken = 0

    def __getitem__(self, index):
        Counted.taken += np.size(index)
        return np.asarray(self)[index]


def test_sums_take_no_wider_pieces_than_places_have(monkeypatch):
    """All widths of all places were summed, most of them without a piece: a quarter of the time that lattices took."""
    vocabulary = Vocabulary.load(default_model())
    lattices, plain = Lattices(vocabulary), Lattices(vocabulary)
    rng = np.random.default_rng(7)
    parts = [" " + "".join(w) for w in rng.choice(list("etaoinshrdlucmqxz7é"), (400, 14)).tolist()]
    monkeypatch.setattr(Counted, "taken", 0)
    lattices._lifted = lattices._lifted.view(Counted)
    starts = lattices.starts(parts)
    widest = 0
    for start, part in zip(starts.tolist(), parts, strict=True):
        for i in range(len(part)):
            symbol = int(lattices.symbol[lattices.first[start + i]])  # the longest comes first
            widest += int(lattices._length[symbol]) if symbol < vocabulary.size else 1
    assert Counted.taken <= 1.5 * widest
    for part in parts[::40]:
        assert lattice(lattices, part) == lattice(plain, part)
