import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) pairs, with columns that clash with names the operators use."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
        if extra:
            for name in ("length", "n", "rank", "start", "anchor", "text_key", "shard", "found", "n_words", "name"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make
