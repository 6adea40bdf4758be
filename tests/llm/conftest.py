import pytest

pytest.importorskip("kindred.llm")

#: Columns whose names an operator might use inside.
CLASH = "fp long, id long, p int, start long, _spans string, node long, component long, bucket string"


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source): nulls, empty, very long, ties and repeated rows."""
    base = " ".join(f"w{i % 97} x{i * 7 % 211}" for i in range(60))
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " more", None, None), (4, None, "en", "a"), (5, "", "de", "b"),
        (6, " \n\t ", "de", "b"), (7, "one", "fr", "b"), (8, "one two", "fr", "b"), (9, "ONE two", "fr", "b"), (10, "x" * 60_000, "en", "a"),
        (11, "word " * 20_000, "en", "a"), (12, "lead  two\n spaces  é ñ 北京 \U0001F600 don't <|endoftext|>x", "es", "c"), (12, "same id, other text", "es", "c"),
        (13, base, "en", "a"), (13, base, "en", "a"), (None, "no id at all", "en", "a"), (14, "a " + base[200:500] + " z", "en", "a"),
        (15, "\u00a0nbsp\u2003wide", "en", None)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "s", 5, 6, "b") for r in edge_rows], "doc_id long, text string, lang string, source string, " + CLASH)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
