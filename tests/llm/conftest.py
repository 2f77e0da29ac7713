import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, target int, score string, label string, node string"


def prose(seed: int, n: int, letters: str = "etaoinshr") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a null id, and columns whose names the operators use."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 60), "en", "a", 1, "s", 1, "x", "l", "n"), (2, None, "en", "a", None, None, None, None, None, None), (3, "", None, None, 0, "", 0, "", "", ""),
        (None, prose(3, 40), "de", "b", 5, "s", 1, "x", "l", "n"), (4, long, "en", "a", len(long), "s", 1, "x", "l", "n"), (5, prose(2, 60), None, "b", 1, "s", 2, "y", "l", "n"),
        (6, "12 !! ?? \n\t 7", "de", None, 3, "s", 1, "x", "l", "n"), (6, "12 !! ?? \n\t 7", "de", None, 3, "s", 1, "x", "l", "n"), (2**62 + 1, "far id, " + prose(9, 30), "en", "c", 7, "s", 1, "x", "l", "n"), (7, "one two", "en", "c", 7, "s", 1, "x", "l", "n"),
        (8, "mail me@mail.example.com or call +1 (222) 555-0100, 10.0.0.256 10.0.0.25, 4111 1111 1111 1111", "en", "c", 7, "s", 1, "x", "l", "n"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
