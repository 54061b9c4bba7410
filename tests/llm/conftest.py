import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, words string, _sha string, label int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def table(spark):
    """(doc_id, text[, lang]) rows as documents with extra columns whose names operators use inside."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, 7, "x", "y", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and white texts, repeated rows, ties and a long text."""
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, "One  two"), (None, "one two"),
            (6, "Ünï-cödé 12 ÀB"), (7, LONG), (8, LONG), (9, "..."), (None, None)]
