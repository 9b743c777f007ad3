import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, lang, source]) rows, with columns whose names clash with the operators'."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for c in ("size", "copies", "score", "fp", "digest", "label", "key", "n", "block", "component_id", "perplexity", "v", "shard", "rank"):
                df = df.withColumn(c, df["doc_id"])
        return df

    return make
