import random

import pytest

WORDS = ["".join(random.Random(k).choice("abcdefghijklmnopr") for _ in range(2 + k % 8)) for k in range(350)]
MESSY = "doc_id long, text string, lang string, id long, t long, n int, key long, tails string, seed string, digest string"


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture
def messy(spark):
    """Texts with the usual trouble, in a table whose other columns have the names that operators use inside."""

    def make(texts, ids=None):
        rows = [(k if ids is None else ids[k], t, None, 1, None, 2, 3, "x", None, "y") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, MESSY).repartition(3)

    return make


#: Null, empty, blank, one word, beyond the basic plane, repeated.
EDGES = [None, "", " \n\t ", "word", "\U0001f600 café 中文", "word", None]
