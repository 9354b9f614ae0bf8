import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) or more as a documents table, with columns that clash with names used inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None) for r in rows]
        extra = "row", "point", "sig", "digest", "keep_id", "kept", "words", "score", "text_key", "component", "_id", "held_out"
        table = spark.createDataFrame(full, DOC)
        return table.selectExpr("*", *[f"'clash' AS {name}" for name in extra])

    return make
