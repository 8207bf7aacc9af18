import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, line string, component string, key string, block string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents out of (id, text) or (id, text, lang, source), with columns whose names operators use."""

    def make(rows):
        full = [tuple(r) + ("en", "s1")[len(r) - 2 :] if len(r) < 4 else tuple(r) for r in rows]
        return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in full], SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """A text of ``n`` words of its own random seed."""

    def make(seed, n=60, vocabulary=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Rows that every operator must take: null, empty, blank, repeated, without an id."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "no id here"), (None, None)]
