"""Filter audit: every order and step against counting document by document."""

import collections
import itertools
import re

import duckdb
import pytest

from driftwatch.llm import filters
from driftwatch.llm.oracle import ORACLE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, source string"


def failed(rows):
    """Letters that each row fails."""
    first = {}
    last = (1, 0)
    key = lambda i: last if i is None else (0, i)
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", key(i)), key(i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        out.append("".join(c for c, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            any(c in "#$%&*|" for c in t), key(i) > first[t])) if bad))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    want, shapley = {}, collections.Counter()
    bad = failed(rows)
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, bad) if (s or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                fails = sum(c in f for _, f in mine)
                want[part, order, step] = [len(left), len(gone), fails - len(gone), sum(f == c for _, f in mine),
                                           sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[part, c] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture
def texts(odd):
    long = " ".join(f"word{i}" for i in range(220))
    few = " ".join(f"w{i % 40}" for i in range(300))
    extra = [(20, long), (21, long), (22, long + " #"), (23, few), (24, few.upper()), (25, few.upper()), (None, long), (26, "A" + "b" * 48),
             (27, "A" + "b" * 49), (28, "a\x0bb\x1cc" + long), (29, long.replace(" ", "\n")), (21, long), (20, few)]
    sources = ["s", None, "", "t"]
    return [(i, t, sources[k % 4]) for k, (i, t) in enumerate([*odd, *extra])]


@pytest.fixture
def labels():
    return [(i, i % 2, i // 2 % 2) for i in range(0, 30)] + [(20, 0, 1), (20, 1, 0), (None, 1, 1), (7, None, None)]


def frames(spark, texts, labels):
    docs = spark.createDataFrame([(i, t, "en", s, 5, True, "x", 3) for i, t, s in texts],
                                 "doc_id long, text string, lang string, source string, n_chars long, good boolean, sha string, mask int")
    return docs.repartition(4), spark.createDataFrame([(*x, "q") for x in labels], LABELS)


def test_audit_equals_counting(spark, texts, labels):
    got = filters.audit(*frames(spark, texts, labels)).collect()
    assert len(got) == 600 * 3
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in got} == brute(texts, labels)


def test_sql_agrees(spark, texts, labels):
    docs, known = frames(spark, texts, labels)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", known.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    sql = con.execute(ORACLE["op12_filter_audit"]).df()
    want = {(r.part, r.filter_order, r.step): tuple(int(getattr(r, c)) for c in COLUMNS) for r in sql.itertuples()}
    assert want == brute(texts, labels)


def test_empty_tables_and_fewer_filters(spark, texts, labels):
    docs, known = frames(spark, texts, labels)
    assert filters.audit(docs.filter("false"), known).count() == 0
    bare = filters.audit(docs, known.filter("false")).collect()
    assert len(bare) == 1800 and not any(r.good_lost or r.toxic_lost for r in bare)
    two = filters.audit(docs, known, "AD").collect()
    whole = brute(texts, labels)
    assert len(two) == 2 * 2 * 3
    for r in two:
        if r.step == 1:                                     # the first step does not depend on the filters behind it
            order = r.filter_order[0] + "".join(c for c in "ABCDE" if c != r.filter_order[0])
            assert (r.kept, r.removed) == whole[r.part, order, 1][:2]


def test_counters_do_not_carry():
    """Sums that fill all bits of a count stay in their fields."""
    worth = filters.packed_masks("ABC")
    many = (1 << 62) - 1
    removed, n = filters.unpacked(worth[0b101] * many + worth[0] * 5, "ABC")
    assert n == many + 5
    for o, order in enumerate(filters.orders("ABC")):
        s = next(s for s, c in enumerate(order) if c in "AC")
        assert removed[o].tolist() == [many if k == s else 0 for k in range(3)]


def test_many_parts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(filters, "MANY_PARTS", 2)
    rows = [(i, "x y", f"p{i % 9}") for i in range(40)]
    got = filters.audit(*frames(spark, rows, [])).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in got} == brute(rows, [])
