import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, Score double, mix_slot int, n int, lines int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) with extra columns whose names clash with inner ones."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), "x", 0.5, 7, 3, 1) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


LONG = "word " * 40_000

#: Nulls, empty and wordless texts, repeated rows, equal texts, a very long text.
ODD_ROWS = [
    (1, "one two three four five six", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \t\n", "fr", "b"),
    (5, "One two three four five six", "en", "a"), (5, "One two three four five six", "en", "a"), (None, "lonely text", None, "c"),
    (6, LONG, "de", "a"), (7, LONG, "de", "a"), (8, "\x00 é 漢字 \U0001F600", "fr", "c"), (9, None, "en", "a"),
]
