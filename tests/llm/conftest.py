import random

import pytest

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, chunk string, row int, rid string, part int, length int, ids int, score string, kept int, root int, n int"


def clash(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), "c", 1, "r", 2, 3, 4, "x", 5, 6, 7)


def table(spark, rows):
    return spark.createDataFrame([clash(*r) for r in rows], CLASHING)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, empty and blank texts, ties, repeated rows, one very long text."""
    rng = random.Random(9)
    same = sentence(rng, 60)
    rows = [(None, None), (None, "a b"), (1, None), (2, ""), (3, " \n\t "), (4, same), (5, same), (5, same), (6, same.upper()), (7, "é" * 50), (8, sentence(rng, 30_000, 5000)), (9, "x " * 300), (9, "1.2.3.4 me@x.org")]
    return rows + [(20 + k, sentence(rng, rng.randint(1, 90))) for k in range(40)]
