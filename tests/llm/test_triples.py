"""The model of words, pairs and triples against plain dictionaries, on odd rows."""

import collections
import math
import random

import numpy as np
import pytest

from driftwatch.llm import lm, triples
from test_texts import FOLD, SPACE, held


def step(p):
    """log10 of a quantised weight."""
    return round(min(math.log10(p) / triples.LEAST, 1) * (triples.LEVELS - 1)) * triples.LEAST / (triples.LEVELS - 1)


@pytest.mark.parametrize("head,share", [(1 << 20, 1_000_000), (1 << 20, 300), (3, 300)])
def test_score_is_that_of_all_triples(table, odd, head, share, monkeypatch):
    monkeypatch.setattr(triples, "HEAD", head)
    monkeypatch.setattr(triples, "SHARE", share)
    rng = random.Random(5)
    rows = odd + [(i, " ".join(f"v{rng.randrange(60)} of{i % 7} The" for _ in range(60))) for i in range(10, 70)]
    rows += [(i, "seldom names met twice seldom names") for i in range(90, 96)]
    tokens = [(i, SPACE.findall((t or "").translate(FOLD)) + ["\n"]) for i, t in rows]
    train = [t for i, t in tokens if not held(i, 7)]
    words = collections.Counter(w for t in train for w in t)
    below, d = sum(words.values()) + len(words) + 1, triples.DISCOUNT
    two = collections.Counter(p for t in train for p in zip(["\n"] + t, t))
    three = collections.Counter(p for t in train for p in zip(["\n"] + t, t, t[1:]))
    sums, kinds = collections.Counter(), collections.Counter()
    for gram, n in [*two.items(), *three.items()]:
        sums[gram[:-1]] += n
        kinds[gram[:-1]] += 1

    def p(context, word):
        shorter = p(context[1:], word) if context else (words[word] + 1) / below
        if not context or not sums[context]:
            return shorter
        n = (two if len(context) == 1 else three)[(*context, word)]
        own = 10 ** step((n - d) / sums[context]) if n else 0.0
        return own + 10 ** step(d * kinds[context] / sums[context]) * shorter

    def score(t):
        return math.log10(p(("\n",), t[0])) + sum(math.log10(p(g[:2], g[2])) for g in zip(["\n"] + t, t, t[1:]))

    got, pairs = triples.scores(table(rows)), lm.scores(table(rows))
    same = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    assert got.columns == pairs.columns
    order = lambda rs: sorted(([str(r.doc_id), *(r[c] for c in same[1:]), round(r.base_score, 6)] for r in rs))
    got = got.collect()
    assert order(got) == order(pairs.collect())
    found, want = sorted((str(r.doc_id), r.score) for r in got), sorted((str(i), score(t)) for i, t in tokens)
    assert [i for i, _ in found] == [i for i, _ in want]
    assert all(abs(a - b) <= 1e-6 * (1 + abs(b)) for (_, a), (_, b) in zip(found, want))
    assert share > 300 or max(words.values()) > share
    assert triples.scores(table([])).count() == 0


def test_levels_find_what_they_hold():
    rng = np.random.default_rng(4)
    for n, universe in ((0, 1 << 40), (1, 3), (60, 90), (70_000, 1 << 41)):
        v = np.unique(rng.integers(0, universe, n))
        level = triples.Level.encode(v, universe)
        assert (level.find(v) == np.arange(len(v))).all()
        q = rng.integers(0, universe, 5000)
        at = np.minimum(np.searchsorted(v, q), max(len(v) - 1, 0))
        assert (level.find(q) == np.where(v[at] == q, at, -1) if len(v) else level.find(q) == -1).all()
