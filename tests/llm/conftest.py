import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, size string, hash int, removed string, weight double, bucket int, row string, label string"


@pytest.fixture
def edge_docs(spark):
    """Nulls, blanks, ties, repeated rows, a long text, and columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    rows = [(1, "the cat sat on the mat and the dog ran"), (2, None), (3, ""), (4, " \t\n"), (5, "the cat sat on the mat and the dog ran"), (6, "a"), (6, "a"), (7, long), (None, "no id here at all in this row"), (None, None), (8, "é ß 日本語 😀\u0000   x"), (8, "other text under the same id")]
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, None if i == 4 else f"s{(i or 0) % 3}", None if t is None else len(t), 1, "s", 1, "r", 0.5, 2, "x", "l") for i, t in rows], COLUMNS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


def near_texts(seed: int, n: int, edits: int = 4, words: int = 60) -> list[str]:
    """Texts of a few families: copies with some words replaced, some of them with no edit."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    bases = [[rng.choice(vocabulary) for _ in range(words)] for _ in range(max(2, n // 8))]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
