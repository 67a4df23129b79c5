import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) to a documents table with columns that clash in name with what operators use."""

    def make(rows):
        full = [(d, t, "en", s, len(t) if t is not None else None, 7, "x") for d, t, s in (r if len(r) == 3 else (*r, "a") for r in rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score int, vid string")

    return make


@pytest.fixture(scope="session")
def prose():
    """n invented texts of the given number of words."""
    import random

    def make(n, words=120, seed=0):
        rng = random.Random(seed)
        vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(800)]
        return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]

    return make


#: Texts that every operator has to stand: null, empty, blank, one word, very long, marks, other scripts.
ODD = [None, "", " \n\t ", "word", "long " * 60_000, "x" * 200_000, "\u0000 \x1c\x85 \u00a0 end", "日本語のテキスト 😀 e\u0301", "@ + 1 . : = AKIA token="]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
