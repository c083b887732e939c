import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, h long, fp string, first string, role string"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text, source), with further columns whose names the operators use themselves."""

    def make(rows, repartition=3):
        full = [(i, t, "en", s, len(t or ""), 0.5, 7, 1, "x", "y", "z") for i, t, s in rows]
        return spark.createDataFrame(full, DOCS).repartition(repartition)

    return make


LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, LONG, "b"), (6, "same text here for all of us", "a"), (7, "same text here for all of us", None),
    (7, "same text here for all of us", None), (None, "no id at all in this row", "c"), (9, "é 日本 𝒳 ü", "c"), (10, "A B C", "é"), (10, "another text with the same id", "é"),
]


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture
def none(docs_of):
    return docs_of([(1, "x", "a")]).where("false")
