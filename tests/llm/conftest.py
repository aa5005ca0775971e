import random

import pytest

WORDS = "the of and to in is for that with on stone river light paper window garden mountain letter music winter summer copper silver market".split()


@pytest.fixture
def prose():
    """Sentences of plain words, the same for a seed."""

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + (f"{r.randrange(900)}"[:0] if r.random() < 0.9 else r.choice("abcdefgh") * 2) for _ in range(n))

    return make


@pytest.fixture
def docs(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        full = [(i, t, None, None, None) if len(x) == 2 else x for x in rows for i, t in [x[:2]]]
        return spark.createDataFrame(full, schema)

    return make
