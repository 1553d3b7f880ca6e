import pytest


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) as a documents table with an extra column whose name operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, bucket string")

    return make


@pytest.fixture
def awkward():
    """Null and empty texts, ties, repeated rows, a null id and a very long text."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
    return [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "Same text here for all of us"), (5, "same  TEXT here for all of us"), (None, "no id at all"), (7, long), (8, "   \n \t "), (9, "x\0y 　z é é ﬁ")]
