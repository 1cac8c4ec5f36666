"""Small tables that every operator has to survive: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, token string, component string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Two extra columns have names that operators use themselves."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, words, "en", "a"), (2, words, "en", "a"), (3, words + " tail", "en", None), (4, None, None, "b"), (5, "", "en", "b"), (None, "no name here at all for this text", None, None),
        (7, "one", "en", "a"), (7, "one", "en", "a"), (8, " \t\n\x0b\f\r ", "fr", "b"), (9, "é ß 漢字 🙂 <|endoftext|> Σ", "fr", "b"), (10, ("lange zeile mit worten " * 4000), "de", "c"),
        (11, "the same five words again the same five words again", "en", "a"), (12, "123 456 !!!", "en", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", "y") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest given table of documents."""
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("tables not present")
    return spark.read.parquet(path)
