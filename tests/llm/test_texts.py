"""Operators that read texts in numpy batches, against brute force and on odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from driftwatch.llm import credentials, flat, language, licenses, lm, minhash, packing, pii, quality
from driftwatch.llm.queries import vocabulary

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def held(i, modulus):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == 2


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- words ---------------------------------------------------------------

@pytest.mark.parametrize("size", [1, 7, 1000])
def test_words_and_hashes(size):
    texts = ["Ab c,d  é\tx", None, "", "  ", "hello", "A b", "ÀB 12-3", "x", "a\x0bb", "日本 語"]
    for kind, pattern in (("space", SPACE), ("plain", PLAIN)):
        got, codes = [], {}
        for b in flat.blocks(pa.array(texts), size):
            w = flat.words(b, kind)
            h, k = flat.span_hashes(b.data, w.start, w.end), w.begins
            mine = [b.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
            for word, code in zip(mine, h.tolist()):
                assert codes.setdefault(word, code) == code
            got += [mine[k[d]:k[d + 1]] for d in range(len(b))]
        assert got == [pattern.findall((t or "").translate(FOLD)) for t in texts]
        assert len(set(codes.values())) == len(codes)


def thue_morse(letters, flip):
    """A word and its complement that a polynomial hash modulo 2^64 cannot tell apart, whatever its base."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(letters))


@pytest.mark.parametrize("letters", [1024, 2048, 4096])
def test_word_hashes_tell_long_words_apart(table, letters):
    one, other = (thue_morse(letters, flip) for flip in (0, 1))
    block = next(flat.blocks(pa.array([f"x {one} {other} {one} {one}a"])))
    w = flat.words(block)
    h = flat.word_hashes(block.data, w.start, w.end)
    assert len(set(h.tolist())) == 4 and h[1] == h[3]
    rows = {r.doc_id: r for r in minhash.near_groups(table([(1, one), (2, other), (3, one)])).collect()}
    assert [rows[i].component_id for i in (1, 2, 3)] == [1, 2, 1]
    encoder, ids = packing.Encoder(vocabulary()), []
    for text in (one, other):
        ids.append(encoder.encode(next(flat.blocks(pa.array([text]))))[0].tolist())
    assert ids == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in (one, other)]
    known = {r.doc_id: r.n_known for r in lm.scores(table([(1, one), (2, other)])).collect()}
    trained = [t for i, t in ((1, one), (2, other)) if not held(i, 7)]
    assert known == {i: 1 + (t in trained) for i, t in ((1, one), (2, other))}


def test_word_hashes_depend_on_bytes_and_length_only():
    data = np.frombuffer(b"abcdefgh abcdefg abcdefgh\x00 abcdefghi  abcdefgh", np.uint8)
    start, end = np.array([0, 9, 17, 27, 37, 38, 39]), np.array([8, 16, 26, 36, 37, 46, 39])
    h = flat.word_hashes(data, start, end).tolist()
    assert h[0] == h[5] and h[4] == h[6] and len(set(h)) == 5


def test_ngrams_stay_inside_documents():
    rng = np.random.default_rng(0)
    counts = np.array([0, 3, 7, 0, 1, 5, 0])
    words = rng.integers(0, 4, counts.sum()).astype(np.uint64)
    grams, doc = flat.ngrams(words, counts, 3)
    cut, want = np.split(words, np.cumsum(counts)[:-1]), []
    for d, w in enumerate(cut):
        want += [(d, tuple(w[i:i + 3].tolist())) for i in range(max(len(w) - 2, 1) if len(w) else 0)]
    assert doc.tolist() == [d for d, _ in want]
    codes = {}
    for (_, g), code in zip(want, grams.tolist()):
        assert codes.setdefault(g, code) == code
    assert len(set(codes.values())) == len(codes)


# ---- near duplicates -----------------------------------------------------

def shingles(text):
    w = SPACE.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        comp = min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else d
        out.append((d, len(sets[i]), comp, d == comp))
    return collections.Counter(out)


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    rows, n = [], 0
    for length in (3, 6, 12, 40, 150):
        base = [word() for _ in range(length)]
        for _ in range(8):
            copy = [word() if rng.random() < 0.6 / max(length, 5) else w for w in base]
            rows.append((n, " ".join(copy + [word() for _ in range(rng.randrange(3))])))
            n += 1
    star = [word() for _ in range(200)]            # copies that are near their centre only
    rows.append((n, " ".join(star)))
    for k in range(6):
        rows.append((n + 1 + k, " ".join([w if not 30 * k <= i < 30 * k + 24 else word() for i, w in enumerate(star)])))
    shared = " ".join(word() for _ in range(60))   # a passage in many different texts
    rows += [(n + 10 + k, shared + " " + " ".join(word() for _ in range(50))) for k in range(8)]
    return rows


def test_near_groups_equal_brute_force(table, odd):
    rows = near_copies(5) + [(i if i is None else i + 1000, t) for i, t in odd]
    got = minhash.near_groups(table(rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_groups(rows)


def test_drop_near_copies(table):
    rows = near_copies(6) + [(2000, None), (2001, "")]
    docs = table(rows)
    left = minhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for (d, _, c, k), n in brute_groups(rows).items() if k)
    assert minhash.near_groups(table([])).count() == 0 and minhash.drop_near_copies(table([])).count() == 0


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(3)
    for n, share in ((40, 0.75), (400, 0.75), (3000, 0.5), (3000, 0.0)):
        errors = []
        for _ in range(20):
            both = rng.integers(0, 1 << 63, int(2 * n * share / (1 + share)), dtype=np.uint64)
            own = [rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64) for _ in range(2)]
            sig = [minhash.registers(np.sort(np.concatenate([both, o]) * np.uint64(2)), np.array([n])) for o in own]
            union = 2 * n - len(both)
            errors.append(minhash.estimate(*sig, np.array([n]), np.array([n]))[0] - len(both) / union)
        assert abs(np.mean(errors)) < 0.06 and max(map(abs, errors)) < minhash.margin(np.array([n]))[0]


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)] + [(200, 300), (200, 400), (5, 5)]
    got = {r.row: r.label for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in (200, 300, 400)}


# ---- language model ------------------------------------------------------


def test_labels_after_further_edges(spark):
    edge = lambda *pairs: spark.createDataFrame([*pairs], "a long, b long")
    first, more = [(5, 2), (9, 7), (7, 8), (20, 21)], [(9, 5), (30, 31), (31, 1), (2, 5), (40, 20)]
    labels = minhash.components(edge(*first))
    got = {r["row"]: r.label for r in minhash.joined_labels(labels, edge(*more)).collect()}
    assert got == {r["row"]: r.label for r in minhash.components(edge(*first, *more)).collect()}


def test_elias_fano_finds_every_member():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 50), (1, 3), (60, 90), (900, 131_136)):
        v = np.sort(rng.choice(universe, n, replace=False)).astype(np.int64)
        ef = lm.EliasFano.encode(v, universe)
        q = np.arange(universe)
        want = np.full(universe, -1)
        want[v] = np.arange(n)
        assert (ef.find(q, np.zeros(universe, int), np.full(universe, n)) == want).all()


@pytest.mark.parametrize("head", [3, 1 << 20])
def test_scores_equal_brute_force(table, odd, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    rng = random.Random(2)
    rows = odd + [(i, " ".join(rng.choice(["The", "cat", "sat", f"r{rng.randrange(90)}"]) for _ in range(rng.randrange(40))))
                  for i in range(10, 70)]
    tokens = [(i, SPACE.findall((t or "").translate(FOLD)) + ["\n"]) for i, t in rows]
    counts = collections.Counter(w for i, t in tokens if not held(i, 7) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(t), sum(counts[w] > 0 for w in t),
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in tokens)
    got = lm.scores(table(rows)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id, 7) for r in got)
    assert all(r.score < 0 for r in got)
    assert lm.scores(table([])).count() == 0


@pytest.mark.parametrize("head", [3, 1 << 20])
def test_score_is_that_of_all_pairs(table, odd, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "SHARE", 300)
    rng = random.Random(5)
    rows = odd + [(i, " ".join(f"v{rng.randrange(6000)} of{i % 7}" for _ in range(90))) for i in range(10, 90)]
    rows += [(i, "seldom names met twice seldom names") for i in range(90, 96)]
    tokens = [(i, ["\n", *SPACE.findall((t or "").translate(FOLD)), "\n"]) for i, t in rows]
    train = [t for i, t in tokens if not held(i, 7)]
    words = collections.Counter(w for t in train for w in t[1:])
    pairs = collections.Counter(p for t in train for p in zip(t, t[1:]))
    kinds = collections.Counter(a for a, _ in pairs)
    once, twice = (sum(n == k for n in pairs.values()) for k in (1, 2))
    d, below = min(max(once / (once + 2 * twice), 0.1), 0.9), sum(words.values()) + len(words) + 1
    assert len(words) > lm.VOCAB

    def logp(a, b):
        share = (words[b] + 1) / below
        return math.log10(max(pairs[a, b] - d, 0) / words[a] + d * kinds[a] / words[a] * share if words[a] else share)

    want = sorted((str(i), round(sum(logp(*p) for p in zip(t, t[1:])), 5)) for i, t in tokens)
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in lm.scores(table(rows)).collect()) == want


def test_trie_is_a_distribution(table):
    pairs = {(0, 1): 5, (0, 2): 1, (1, 0): 3, (1, lm.VOCAB): 2, (70, 70): 1}
    unigram = np.full(lm.VOCAB + 1, 1 / (lm.VOCAB + 1))
    import pandas as pd
    rows = pd.DataFrame([(p, q, n) for (p, q), n in pairs.items()], columns=["prev", "next", "n"])
    trie = lm.Trie([lm.build_shard(part, unigram, 0.5) for _, part in rows.groupby(rows.prev // lm.CONTEXTS)], unigram)
    every = np.arange(lm.VOCAB + 1)
    for prev in (0, 1, 70, 9, 500):
        total = (10 ** trie.log10(np.full(lm.VOCAB + 1, prev), every)).sum()
        assert abs(total - 1) < 0.05, prev
    assert trie.log10(np.array([0]), np.array([1])) > trie.log10(np.array([0]), np.array([2])) > trie.log10(np.array([0]), np.array([3]))


# ---- packing -------------------------------------------------------------

def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    texts = ["a\x0bb\x0cc", "x y z\u0085w", "IT'S. <|endoftext|> a<|ENDOFTEXT|>. <|startoftext|>x", None, "", "  ",
             "é. ̈a ΣΣ. 12.5, don't, a.. b.,", "日本語、テスト。 ½ ②.", "\x1c a\x1db", "word, word. Word."] * 2
    plain, mine = Tokenizer.from_file(vocabulary()), packing.Encoder(vocabulary(), keep=4)
    got = []
    for b in flat.blocks(pa.array(texts), 60):
        ids, n = mine.encode(b)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_pack_covers_every_id_once_with_little_padding(seed):
    rng = np.random.default_rng(seed)
    lengths = [[1], [], [5000, 2048, 3], rng.integers(1, 3000, 800).tolist()][seed]
    rows, cover, padding = packing.pack(lengths), collections.defaultdict(list), 0
    for row in rows:
        size = sum(n for *_, n in row)
        assert 0 < size <= 2048
        padding += 0 if size & (size - 1) == 0 else 2048 - size
        for d, s, n in row:
            cover[d].append((s, s + n))
    for d, n in enumerate(lengths):
        parts = sorted(cover[d])
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert padding <= 0.01 * sum(lengths)
    if seed == 3:
        assert {2048, 1024} <= {sum(n for *_, n in row) for row in rows}
    sizes = np.bincount(packing.step_groups(rows, 16), minlength=0)
    assert not rows or sizes.max() - sizes.min() <= 1


def test_packer_keeps_documents_for_later_ones():
    rng = np.random.default_rng(5)
    packer, lengths, rows = packing.Packer(open_windows=4), rng.integers(1, 2500, 400).tolist(), []
    for k in range(0, 400, 20):
        for doc in range(k, k + 20):
            packer.put(doc, lengths[doc])
        rows += packer.take()
        assert packer.held <= 4 * 2048
    early = len(rows)
    rows += packer.take(last=True)
    cover = collections.Counter()
    for row in rows:
        cover.update({d: n for d, _, n in row} if len({d for d, *_ in row}) == len(row) else
                     {d: sum(n for e, _, n in row if e == d) for d, *_ in row})
    assert cover == {d: n for d, n in enumerate(lengths)} and early > 100 and packer.held == 0
    assert all(sum(n for *_, n in row) in (2048, 1024, 512, 256) or sum(n for *_, n in row) > 2032 for row in rows[:early])


def test_packed_rows(table, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    rows = packing.packed(table(odd), vocabulary()).collect()
    assert sum(r.length for r in rows) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd)
    by_sequence = collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_sequence[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert parts[-1][0] + parts[-1][1] == parts[0][2] <= 2048
    text = dict((i, t) for i, t in odd if i in (6, 7))
    for i, t in text.items():
        own = sorted((r.start, r.ids) for r in rows if r.doc_id == i)
        assert [x for _, ids in own for x in ids] == plain.encode(t, add_special_tokens=False).ids + [1]
    assert packing.packed(table([]), vocabulary()).count() == 0


# ---- personal data -------------------------------------------------------

PII = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
       ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
       ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"),
        lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)),
       ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15)]
PERSONAL = ["é a.b@c.de, x@y@z.org @q.r a@b..c d@e.f.g.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255 1.2.3", "+1 (988) 555-2485 and +12",
            "4111 1111-1111 1111 4111111111111112 4111111111111111.", "a@b.c@d.e _%+-@x-y.z0", "+49 30 1234567, call +1.2.3.4.5.6.7.8.9.0",
            "no data here.", "ip 10.0.0.1\nmail me@you.net"]


def test_personal_data_equals_brute_force(table, odd):
    rows = odd + [(100 + i, t) for i, t in enumerate(PERSONAL * 3)]
    got = pii.personal_data(table(rows)).collect()
    want = []
    for i, t in rows:
        spans = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(PII) for m in p.finditer(t or "") if ok(m[0])]
        want.append((str(i), *(sum(s[3] == name for s in spans) for name, *_ in PII), digest(joined(spans))))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    assert all(set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(",")) for r in got)
    assert pii.personal_data(table([])).count() == 0


def test_crf_decodes_the_best_path():
    rng = np.random.default_rng(4)
    n = len(pii.LABELS)
    crf = pii.Crf(rng.normal(size=(3, pii.SHAPES, n)), rng.normal(size=(n, n)))
    shape, first = rng.integers(0, 50, 12), np.array([0, 5, 6])
    unary, got = crf.scores(shape, first), crf.decode(shape, first)
    import itertools
    for a, b in ((0, 5), (5, 6), (6, 12)):
        value = lambda y: sum(unary[a + i, c] for i, c in enumerate(y)) + sum(crf.move[p, q] for p, q in zip(y, y[1:]))
        assert tuple(got[a:b]) == max(itertools.product(range(n), repeat=b - a), key=value)


def test_crf_learns_shapes_beyond_the_patterns():
    chains = [(np.array([0, 900, 0]), np.array([0, 4, 0])), (np.array([0, 0, 0, 512]), np.array([0, 0, 0, 0]))] * 20
    crf = pii.train(chains)
    assert crf.decode(np.array([0, 0, 900, 512]), np.array([0])).tolist() == [0, 0, 4, 0]


def test_long_chains_are_learnt_in_pieces(table):
    plain = [f"word{'abcdefgh'[k % 8]}" for k in range(400)]
    rows = [(i, " ".join(plain[:i] + [f"me{i}@you.net"] + plain[i:])) for i in range(0, 401, 40)]
    chains = pii.labelled_chains(table(rows), longest=20)
    assert max(len(s) for s, _ in chains) == 20
    assert sum((y == 1).any() for _, y in chains) >= 2 * len(rows) - 2
    first, last = pii.pieces(np.array([0, 5, 26]), np.array([5, 26, 126]), 20)
    assert list(zip(first.tolist(), last.tolist())) == [(0, 5), (5, 25), (15, 26)] + [(26 + k, 46 + k) for k in range(0, 90, 10)]


# ---- secrets -------------------------------------------------------------

def test_secrets_equal_brute_force(table, odd):
    rng = random.Random(1)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = ["password=abc", "PassWord : 'abcdef1'", "api_key=token=abcdefg", f"token = \"{hexes(40)}\" é", "AKIA" + "B2" * 8, "AKIA12",
             "secret:secret:secret:x", "ſecret=abcdefgh", hexes(24) + "g" + hexes(23), "passwd\"=\"a.b/c+d=e-f"] + [
             f"é token = {hexes(40)}." for _ in range(30)] + ["plain words of any kind " * 5] * 3 + [f"see {hexes(20)} there"]
    rows = odd + [(100 + i, t) for i, t in enumerate(texts)]
    any_case = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c + "?" * (c == "_") for c in w)
                        for w in ("password", "passwd", "secret", "token", "api_key"))
    assign = re.compile(rf"""({any_case})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = []
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        want.append((str(i), *(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")), digest(joined(spans))))
    got = credentials.secrets(table(rows)).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    added = [r for r in got if "inferred" in r.spans]
    assert [r.doc_id for r in added] == [100 + len(texts) - 1]     # too short for the pattern, right in format
    assert credentials.secrets(table([])).count() == 0


def test_automaton_merges_states_and_prefers_its_format():
    rng = random.Random(3)
    strings = ["K" + "".join(rng.choice("dx") for _ in range(20)) for _ in range(200)]
    a = credentials.FormatAutomaton(strings)
    assert len(a.states) < 10
    assert a.bits("K" + "dx" * 10) < a.bits("dx" * 10 + "K") and a.bits("K" + "dx" * 10) < a.bits("l" * 21)


# ---- licenses ------------------------------------------------------------

def test_license_places_equal_brute_force(table, odd):
    texts = ["Licensed under the Apache License, Version 2.0.", "GNU General Public License; gnu GENERAL public license",
             "cc by cc-by CC  BY", "This is licensed under a CC BY-NC 4.0.", "released under the MIT license",
             "licensed under the mitt license", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
             "this fine software and associated documentation files", "licensed under the gnu general public license version three"]
    rows = odd + [(100 + i, t) for i, t in enumerate(texts)]
    want = []
    for i, t in rows:
        w = PLAIN.findall((t or "").translate(FOLD))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w))
                  if w[k:k + len(p.split())] == p.split()]
        want.append((str(i), len(w), len(places), str(min((k for k, _ in places), default=None)),
                     str(max((k for k, _ in places), default=None)), ",".join(sorted({x for _, x in places}))))
    got = licenses.licenses(table(rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted(want)
    labels = {r.doc_id: r.labels for r in got if r.doc_id and r.doc_id >= 100}
    assert labels == {100: "apache,apache-2.0", 101: "gpl", 102: "cc-by", 103: "cc-by,cc-by-nc-4.0", 104: "mit,mit-notice", 105: "",
                      106: "mit-text", 107: "gpl"}
    assert licenses.licenses(table([])).count() == 0


def test_template_regions():
    a = licenses.compiled("x-{v}", "a [b c] {v#1-2} d {w:0-1} e")
    assert a.longest("a b c 1 2 d e".split()) == (7, {"v": ["1", "2"]})
    assert a.longest("a 1 d zz e more".split())[0] == 5
    assert a.longest("a b 1 d e".split()) is None and a.longest("a x d e".split()) is None and a.longest([]) is None


# ---- quality and language ------------------------------------------------

def labelled_texts(seed, n=240):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["the", "an", "ou", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(15, 60))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + rng.choice(["***", "###"]) if bad else w for w in words).capitalize() + "."))
        labels.append((i, 0 if bad else 1, "q"))
    return rows, labels


def test_quality_separates_held_out_documents(spark, table, odd):
    rows, labels = labelled_texts(1)
    rows += [(None if i is None else i + 5000, t) for i, t in odd]
    docs, marks = table(rows), spark.createDataFrame([*labels, (7, 1, "twice"), (None, 0, "x"), (8, None, "y")],
                                                     "doc_id long, quality int, text string")
    got = quality.quality(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == held(r.doc_id, 4) for r in got)
    truth = {i: q for i, q, _ in labels}
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth)
    kept = quality.good_documents(docs, marks)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in got if r.predicted)
    assert quality.quality(table([]), marks).count() == 0 and quality.good_documents(table([]), marks).count() == 0


def test_quality_without_two_classes(spark, table):
    marks = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for m in (marks, marks.filter("false")):
        assert len({r.score for r in quality.quality(table([(1, "a"), (3, None)]), m).collect()}) == 1


def test_languages(table, odd):
    rng = random.Random(5)
    parts = {"aa": ["lo", "mi", "ra"], "bb": ["sch", "ung", "ei"], "cc": ["ño", "que", "ción"]}
    text = lambda x, n: " ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(x, 30), x) for i, x in enumerate(list(parts) * 40)]
    rows += [(500, text("aa", 40) + " " + text("bb", 60), None), (501, "12 ... !", "aa"), (502, None, "aa"), (503, "", None)]
    got = {r.doc_id: r for r in language.languages(table(rows + [(i if i is None else i + 900, t, None) for i, t in odd])).collect()}
    assert all(got[i].lang_pred == x and got[i].score > 0.9 for i, _, x in rows[:120])
    assert got[500].lang_pred == "bb" and 0.5 < got[500].score < 0.7 and got[500].langs.startswith("aa:")
    assert all(got[i].lang_pred == language.NONE for i in (501, 502, 503))
    assert all(r.held_out == held(i, 4) for i, r in got.items())
    assert language.languages(table([])).count() == 0
    assert language.languages(table([(1, "abc", None)])).first().lang_pred == language.NONE


def test_pairs_are_deleted_once_they_are_scored(table, monkeypatch):
    made = {}

    def stored(df, name, keep=lm.stored):
        made[name] = keep(df, name)
        return made[name]

    monkeypatch.setattr(lm, "stored", stored)
    got = lm.scores(table([(i, f"some words w{i} and more") for i in range(20)]))
    assert len(got.collect()) == len(got.collect()) == 20
    folders = {name: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for name, df in made.items()}
    assert {name for name, folder in folders.items() if not os.path.exists(folder)} == {"pairs"}
