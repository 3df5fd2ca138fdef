import pytest

#: id, text, lang, source: nulls in every column, empty and blank texts, ties, repeated rows.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog near the old river bank today", "en", "b"),
    (3, "", "en", "a"),
    (4, " \t\n\x0b\x0c\r ", None, "a"),
    (5, None, "fr", None),
    (None, "un deux trois quatre cinq six sept huit neuf dix onze douze", "fr", "c"),
    (7, "un", "fr", "c"),
    (8, "un", "fr", "c"),
    (8, "un", "fr", "c"),
    (9, "été à la plage, ça va? " * 40, "fr", ""),
    (10, "a b\n" * 30 + "a b c # $ | x", "en", "b"),
    (11, "word " * 3000, None, "b"),
    (12, "x" * 70000, "en", "d"),
    (13, "123 456 !!", "en", "d"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """With columns whose names clash with those that operators make."""
    extra = ", ".join(f"{i} AS {c}" for i, c in enumerate(("score", "sid", "n", "k", "uid", "size", "target", "id", "text_", "word", "h", "t", "i", "p0", "held_out")))
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return d.selectExpr("*", extra.split(", ")[0], *extra.split(", ")[1:])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
