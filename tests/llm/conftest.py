import pytest

#: Nulls, empty texts, repeated rows, equal ids with other texts, and columns whose names clash with results.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today.", "en", "a", 5),
    (1, "The quick brown fox jumps over the lazy dog again and again today.", "en", "a", 5),
    (2, None, None, None, None),
    (None, "a text without an id but with words in it", "en", "a", 3),
    (3, "", "en", None, 0),
    (4, " \t\n ", "de", "b", 4),
    (5, "Short one", "fr", "b", 9),
    (6, "word " * 30_000, "en", "a", 150_000),
    (7, "É ñ 漢字 😀 <|endoftext|> don't 123 under the MIT license, under the MIT license!", "es", "c", 70),
    (7, "another text of the same id, cc by nc", "es", "c", 30),
]
CLASHES = ", n_words long, row string, score double, kept boolean, spans string, class long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows that a stage must take as they come, with clashing extra columns."""
    return spark.createDataFrame([(*r, 1, "x", 0.5, True, "s", 1) for r in ROWS], SCHEMA + CLASHES)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
