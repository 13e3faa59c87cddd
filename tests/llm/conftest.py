import pytest

TEXT = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key bigint, _word bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of (doc_id, text) rows, with further columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], TEXT)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, a null id, marks that operators use."""
    long = " ".join(f"word{k % 997}" for k in range(60_000))
    return docs([(1, None), (2, ""), (3, " \t\n"), (4, "Same text here now"), (5, "same TEXT here now"), (5, "same TEXT here now"), (6, long), (None, "no id at all, but text"), (7, "\u0001\x00 é 中文 \U0001f600"), (8, "12345 !!!")])


@pytest.fixture(scope="session")
def none(docs):
    return docs([])
