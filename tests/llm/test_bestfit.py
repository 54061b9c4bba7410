"""Packing by a configuration program: whole documents, exact places, few sequences."""

import collections
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from driftwatch.llm import bestfit, flat
from driftwatch.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_tokenizer():
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", " \n ", " ", "　", " ", "\u0085", "\x1c", "a", "Word", "word,", "it's", "don't.",
             "12.5", "é", "日本語", "ñandú.", "<|endoftext|>", "...", ",", "'s", "слово", "𝒜", "à", " ", "ሀ"]
    texts = ["", None, " ", " a", "a ", "a b", "a  b", "a 　b", "　 b", "x,", "x, y. z", ". a", "a  b", "a  b"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    mine, got = bestfit.ByteEncoder(PATH, keep=50, end=2), []
    for b in flat.blocks(pa.array(texts), 300):
        ids, n = mine.encode(b)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    want = plain()
    for t, ids in zip(texts, got, strict=True):
        assert ids == want.encode(t or "", add_special_tokens=False).ids + [2], repr(t)


def test_pieces_of():
    assert bestfit.pieces_of(5) == [(0, 5)] and bestfit.pieces_of(1024) == [(0, 1024)]
    assert bestfit.pieces_of(2050) == [(0, 2), (2, 1024), (1026, 1024)]


def least(items, window):
    """Fewest windows, by trying all ways."""
    best = len(items)

    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for k in sorted(set(rooms), reverse=True):
            if k >= rest[0]:
                left = list(rooms)
                left.remove(k)
                go(rest[1:], [*left, k - rest[0]])
        go(rest[1:], [*rooms, window - rest[0]])

    go(sorted(items, reverse=True), [])
    return best


def packed_well(items, window):
    lengths, counts = np.unique(items, return_counts=True)
    fillings, windows = bestfit.plan(lengths.astype(np.int64), counts.astype(np.int64), window)
    assert (fillings * windows[:, None]).sum(0).tolist() == counts.tolist() and (fillings @ lengths <= window).all()
    return int(windows.sum())


def test_plan_is_nearly_least_on_small_sets():
    rng = random.Random(7)
    for _ in range(25):
        items = [rng.randint(2, 14) for _ in range(rng.randint(1, 9))]
        assert packed_well(items, 20) <= least(items, 20) + 1
    # Taking the largest piece first, a filling at a time, needs 11 windows here; 10 are enough.
    assert packed_well([7] * 10 + [9] * 10 + [4] * 10, 20) == 10


def test_program_finds_the_bound():
    """Three kinds of pieces of which one each fill a window."""
    lengths, counts = np.array([205, 307, 512]), np.array([900, 900, 900])
    fillings, amounts = bestfit.fractions(lengths, counts, 1024, rounds=400)
    assert (amounts @ fillings >= counts * 0.999).all() and amounts.sum() < 900 * 1.06
    assert packed_well(np.repeat(lengths, counts), 1024) <= 909
    rng = np.random.default_rng(1)
    items = np.minimum(rng.geometric(1 / 300, 30_000), 1024)
    assert packed_well(items, 1024) <= 1.001 * items.sum() / 1024 + 1


@pytest.mark.parametrize("seed", range(3))
def test_slots_are_gapless(seed):
    rng = np.random.default_rng(seed)
    items = rng.integers(1, 65, 700)
    lengths, counts = np.unique(items, return_counts=True)
    slots = bestfit.Slots(lengths, *bestfit.plan(lengths, counts, 64))
    rows = collections.defaultdict(list)
    for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
        for s, o in zip(*slots.place(n, np.arange(c)), strict=True):
            rows[int(s)].append((int(o), n))
    assert set(rows) == set(range(slots.sequences))
    for parts in rows.values():
        ends = list(itertools.accumulate((n for _, n in sorted(parts)), initial=0))
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64


def test_packed_rows(table, odd):
    rows, want = bestfit.packed(table(odd), PATH).collect(), plain()
    left = collections.Counter((i, tuple(want.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in odd)
    same = collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 1024
        same[r.doc_id, r.doc_tokens].append(r)
    for (i, n), parts in same.items():
        cuts = bestfit.pieces_of(n)
        copies = len(parts) // len(cuts)
        assert sorted((r.piece, r.start, r.length) for r in parts) == sorted((k, s, m) for k, (s, m) in enumerate(cuts) for _ in range(copies))
        for r in parts:
            assert any(d == i and len(ids) == n and list(ids[r.start:r.start + r.length]) == r.ids for d, ids in left)
        assert copies == sum(c for (d, ids), c in left.items() if d == i and len(ids) == n)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and sum(parts[-1]) <= 1024
    assert len(sequences) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert bestfit.packed(table([]), PATH).count() == 0
