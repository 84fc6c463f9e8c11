"""A small table with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, row long, n_words long"


@pytest.fixture(scope="session")
def odd_rows():
    base = "one two three four five six seven eight nine ten " * 8
    return [
        (1, None, "en", "a", 0), (2, "", None, None, None), (3, "   \n\t ", "en", "a", 6), (4, base, "en", "a", 1), (4, base, "en", "a", 1),
        (5, base, "fr", "b", 2), (None, "a null id " + base, "en", "a", 3), (6, "long " * 60000, "de", "c", 300000), (7, "Ünïcödé 你好 мир 🙂 é İ", "de", "c", 9),
        (8, "word", "en", "a", 4), (9, "mail bob.17@mail1.example.com or 10.0.0.1, call +1 (269) 555-3296", "en", "a", 10), (10, "x\x00y\x1fz w v", "en", "a", 7),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, 99, 0.5, 7, 1) for r in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
