import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows):
        """rows of (doc_id, text)"""
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    import random

    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9))) for _ in range(4000)]

    def text(seed, n):
        return " ".join(random.Random(seed).choices(vocabulary, k=n))

    return text
