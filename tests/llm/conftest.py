import random

import pytest

ODD = [
    (1, None), (2, ""), (3, "   \n "), (4, "one"), (4, "one"), (None, "no id here but some words in a row"), (5, "Ünïcödé wörds — “quotes” and\ttabs\x0band feeds"),
    (6, "a" * 3000), (7, "long " * 4000), (8, "\U0001f600   \x00 nul"),
]


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, "x", 1, 2.0, "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, rk int, log_weight double, n_lines string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
