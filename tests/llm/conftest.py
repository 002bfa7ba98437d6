import pytest

#: Columns whose names the operators use inside.
CLASH = ["key", "term", "score", "node", "rep", "part", "hash", "line", "label", "n", "start", "gone_lines"]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns of clashing names beside them."""
    def make(rows):
        full = [(i, t, "en", None, len(t) if t is not None else None, *[7] * len(CLASH)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                           + ", ".join(f"{c} int" for c in CLASH))
    return make


EDGES = [(None, "a row without an id, long enough to take part in everything here"), (1, None), (2, ""), (3, "   "), (4, "word"),
         (5, "one two three four five six seven eight nine ten eleven twelve"), (5, "one two three four five six seven eight nine ten eleven twelve"),
         (6, "one two three four five six seven eight nine ten eleven twelve"), (7, "x" * 5000), (8, "é\u4e2d \U0001f600 Größe\n" * 40),
         (9, " ".join(f"w{i}" for i in range(30000)))]


@pytest.fixture(scope="session")
def edges(docs):
    return docs(EDGES)


@pytest.fixture(scope="session")
def edge_rows():
    return EDGES
