import pytest

#: Columns whose names the operators use themselves.
CLASH = ["kind", "part", "digest", "size", "y", "score", "copies", "u", "v", "row", "keep_id", "n_words", "ids"]
SCHEMA = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` string" for c in CLASH)])

LONG = " ".join(f"word{i * i % 9973}" for i in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river bank"
TEXTS = [
    (1, PROSE), (2, PROSE.upper()), (3, PROSE + " today"), (4, ""), (5, None), (6, LONG), (7, "one two"), (8, " \t\n"), (9, "ÉCOLE été à l'île " * 9), (10, PROSE), (10, PROSE), (11, "# $ % " * 40),
    (None, "no id here but plenty of words to make the text count as a document of its own and be kept in the end"), (None, None), (12, "same line\nsame line\nother line"), (13, "a\x00b \x1c \xa0 c d 😀"),
]
ROWS = [(i, t, (None, "en", "fr")[k % 3], (None, "s1", "", "s2")[k % 4], None, *("x" for _ in CLASH)) for k, (i, t) in enumerate(TEXTS)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i == 3), "x") for i in range(1, 14)] + [(None, 1, 1, "x"), (2, None, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
