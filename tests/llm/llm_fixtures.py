import pytest

SF01 = "/root/testdata/sf0.01"


ODD_TEXTS = [
    (1, "All rights reserved. CC BY; the GNU General Public License", "b"),
    (2, None, None),
    (3, "", "a"),
    (4, "  \n\t ", "a"),
    (5, "one", "b"),
    (5, "one", "b"),
    (6, "one", None),
    (None, "the same text without an id " * 30, "c"),
    (None, None, "c"),
    (7, "the same text without an id " * 30, "c"),
    (8, "é ü İK ﬁ " * 40 + "x" * 300, "b"),
    (9, "word " * 30_000, "a"),
    (10, "word " * 30_000 + "end", "a"),
    (11, "it's <|endoftext|> 12  34\r\n wide space\n\nlast ", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [(i, t, "en", s, 0, "x", 1, 1, "y", 2, 3.0, 4, "z", 5, 6) for i, t, s in ODD_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string, chunk int, size int, hashes string, epochs int, target double, _key int, key string, part int, unit int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
