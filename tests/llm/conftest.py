import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make(spark):
    """Makes a table of documents from (doc_id, text) or (doc_id, text, source) rows; ``extra`` adds columns with awkward names."""

    def documents(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("size", "key", "n", "keep_id", "words", "score", "shard", "component_id", "hash", "row", "copies"):
                df = df.withColumn(name, df.lang)
        return df

    return documents


LONG = " ".join(f"word{i}" for i in range(30_000))
