"""Exact duplicates and decontamination against brute force."""

import hashlib
import random
import re

import duckdb

from driftwatch.llm import decontaminate, exact
from driftwatch.llm.oracle import ORACLE

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def test_exact_groups_of_odd_rows(table, odd):
    rows = exact.exact_groups(table(odd)).collect()
    assert len(rows) == len(odd)
    flat = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for text in {flat(t) for _, t in odd}:
        ids = [i for i, t in odd if flat(t) == text]
        mine = [r for r in rows if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert len(mine) == len(ids) and {r.group_size for r in mine} == {len(ids)}
        assert {r.keep_id for r in mine} == {min((i for i in ids if i is not None), default=None)}
        assert sum(r.kept for r in mine) == 1 and all(r.doc_id == r.keep_id for r in mine if r.kept)


def test_exact_needs_no_full_fan_in_and_no_rows(table):
    rows = [(i, f"t{i % 7}") for i in range(300)]
    for runs, fan_in in ((1, 2), (5, 2), (64, 3)):
        got = exact.exact_groups(table(rows), runs, fan_in).collect()
        assert all(r.keep_id == r.doc_id % 7 and r.kept == (r.doc_id < 7) for r in got) and len(got) == 300
    assert exact.exact_groups(table([])).count() == 0 and exact.drop_copies(table([])).count() == 0


def test_drop_copies_keeps_columns_and_one_row_a_text(table, odd):
    docs = table(odd)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5]) for r in left.collect())
    assert got == sorted((i is None, i or 0, (t or "")[:5]) for i, t in [
        (1, None), (3, " \t\n"), (4, "one two"), (5, "One  two"), (6, "Ünï-cödé 12 ÀB"), (7, odd[8][1]), (9, "...")])


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, held = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if own := grams.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    held |= own
        out.append((i, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def columns(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    item = lambda n: " ".join(rng.choice("abcdef") + str(rng.randrange(9)) for _ in range(n))
    items = [(10, item(30)), (9, item(12)), (100, item(10)), (None, item(9)), (5, item(4)), (5, "Q1!"), (6, ""), (7, None)]
    docs = []
    for i in range(60):
        source = (rng.choice(items)[1] or "").split()
        a = rng.randrange(len(source) + 1)
        docs.append((i, item(rng.randrange(30)) + " " + " - ".join(source[a:a + rng.randrange(25)]).upper() + ". " + item(rng.randrange(9))))
    return docs, items


def test_contamination_equals_brute_force(spark, table, odd):
    for seed in (1, 2):
        docs, items = made(seed)
        docs += odd
        bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, length int")
        for grams in (200_000, 3):  # with the set in the filter, and by join
            assert columns(decontaminate.contamination(table(docs), bench, max_grams=grams)) == brute(docs, items)


def test_contamination_of_empty_tables(spark, table):
    none = spark.createDataFrame([], "item_id long, text string")
    assert columns(decontaminate.contamination(table([(1, "a b")]), none)) == brute([(1, "a b")], [])
    assert decontaminate.contamination(table([]), none).count() == 0
    assert decontaminate.decontaminated(table([]), none).count() == 0


def test_decontaminated_drops_or_cuts(spark, table):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    text = 'say: "x1 A b, c d e f g h i J k" y2!'
    docs = table([(1, text), (2, "a b c d e f g h i"), (3, None)])
    whole = decontaminate.decontaminated(docs, bench)
    assert whole.columns == docs.columns and sorted(r.doc_id for r in whole.collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, bench, spans=True).collect()}
    assert cut == {1: 'say: "x1 y2!', 2: "a b c d e f g h i", 3: None}


def test_sql_agrees_on_odd_rows(spark, table, odd):
    docs, items = made(3)
    docs = [d for d in docs + odd if d[0] is not None and d != (4, "one two") and len(d[1] or "") < 1000] + [(4, "one two")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for name, got in (("op1_decontaminate", decontaminate.contamination(table(docs), bench).drop("items")),
                      ("op7_exact_dedup", exact.exact_groups(table(docs)))):
        want = con.execute(ORACLE[name]).df()
        a = sorted(map(str, want[sorted(want.columns)].itertuples(index=False, name=None)))
        b = got.toPandas()
        assert a == sorted(map(str, b[sorted(b.columns)].itertuples(index=False, name=None))), name
