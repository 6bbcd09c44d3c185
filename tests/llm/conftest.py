import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa "

#: Nulls, empty and very long texts, ties, repeated rows, odd white space and non-ASCII, in one small table.
ROWS = [
    (1, LONG * 3, "en", "a", 9),
    (2, LONG * 3, "en", "a", 9),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n\x0b\x0c\r ", "de", "b", 7),
    (6, "One line.\n one LINE. \t\nÉcole É\nécole é\n\nlast", "fr", "b", 1),
    (7, (LONG * 4000).strip(), "en", "c", 1),
    (7, "the same id, another text of a few more words here", "en", "c", 1),
    (8, "tied", "en", "c", 1),
    (8, "tied", "en", "c", 1),
    (None, "no id at all\nOne line.", "en", "a", 1),
    (9, "x\ny\r\nz\nx\nx \n" + LONG, "es", "a", 3),
    (10, "# $ % & | < > *" * 3, "es", None, 3),
    (11, "a b c d e f g h a b c d e f g h q", "es", "a", 3),
]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
