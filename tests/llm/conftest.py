import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns named as results are."""
    long_word, long_text = "x" * 50_000, "Wort und noch ein Wort, das lang ist.\n" * 5_000
    rows = [
        (1, "one two three four five six seven", "en", "a", 33), (2, None, "en", "a", None), (3, "", None, None, 0),
        (4, " \t\r\n\x0b ", "de", "b", 6), (5, long_word, "de", "b", 50_000), (6, long_text, "de", None, len(long_text)),
        (7, "ONE two three four five six seven", "en", "a", 33), (7, "ONE two three four five six seven", "en", "a", 33),
        (None, "no id here", "en", "a", 10), (8, "1234 !? --", "fr", "b", 10), (9, "é ▁ \U0001F600 <|endoftext|> \0", "fr", "a", 9),
    ]
    names = ["score", "h1", "key", "id", "rank", "fp", "n"]
    wide = [(*r, *([0] * len(names))) for r in rows]
    return spark.createDataFrame(wide, DOCS + "".join(f", {n} int" for n in names))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
