import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source[, lang]]), with columns whose names clash with common ones."""

    def made(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "doc_id key", "1 n", "'x' node", "2 size", "3 u", "'y' line", "4 component")

    return made
