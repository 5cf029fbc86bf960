import random

import pytest

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their".split()


@pytest.fixture(scope="session")
def docs(spark):
    """docs(texts, ids=..., langs=..., sources=...) -> documents with a clashing extra column or two."""

    def build(texts, ids=None, langs=None, sources=None):
        n = len(texts)
        rows = [
            (i, t, lang, s, None if t is None else len(t), "extra", 1.5)
            for i, t, lang, s in zip(ids or range(n), texts, langs or ["en"] * n, sources or [f"s{k % 3}" for k in range(n)], strict=True)
        ]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, kept double")

    return build


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n) -> a text of n random words."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "ing", str(r.randrange(9))]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Texts with every awkward case: null, empty, spaces only, one character, ties, very long, other scripts."""
    return [None, "", "   \n\t ", "a", "a", prose(1, 30), prose(1, 30), prose(2, 20_000), "é漢字🙂 ok", "x" * 30_000, "A\x00b\x1c c", "\n\nline\nline\n", None]
