"""Small document tables with every awkward case."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """A documents table from (doc_id, text) pairs, with extra columns that clash with internal names."""
    def make(rows, extra=True):
        df = spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
        if not extra:
            return df
        from pyspark.sql import functions as F
        return df.withColumns({name: F.lit(7) for name in ("fp", "key", "n", "word", "spans", "kept_id", "mark", "rank")})
    return make


@pytest.fixture
def awkward():
    """Null and empty texts, blanks, a null id, repeated rows, equal texts and a very long text."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (None, "a text without an id"), (4, "same text here"),
        (4, "same text here"), (5, "same text here"), (6, long_text), (7, "x" * 70_000), (8, "é 中文 🙂 ok"),
    ]
