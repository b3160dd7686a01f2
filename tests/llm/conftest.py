import pytest

DOCS = "doc_id long, text string"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names used inside."""
    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (None, "some words without an id here", 5, "x"),
            (3, "word " * 30_000, 5, None), (4, "a b c d e f", None, "x"), (4, "a b c d e f", None, "x"),
            (5, " \n\t ", 5, "x"), (6, "é ü 中文 😀", 5, "x"), (7, "line\n\nline\n" * 3, 5, "x")]
    return spark.createDataFrame(rows, f"{DOCS}, node long, places string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def docs_of(spark):
    def make(texts, parts=3):
        rows = texts.items() if isinstance(texts, dict) else enumerate(texts)
        return spark.createDataFrame(list(rows), DOCS).repartition(parts)

    return make
