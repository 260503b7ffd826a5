import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source) rows, with columns that clash and extra ones."""

    def make(rows, parts=3):
        full = [(i, t, "en", (s or [f"src{k % 2}"])[0], len(t or "")) for k, (i, t, *s) in enumerate(rows)]
        df = spark.createDataFrame(full, DOCUMENTS)
        for extra in ("id", "row", "size", "kept", "recipe", "part", "n", "at", "score", "label"):
            df = df.withColumn(extra, df.source)
        return df.repartition(parts) if parts else df

    return make


AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (None, None), (6, "word " * 30000), (7, "word " * 30000), (8, "x" * 50000),
    (9, "Zwölf große Boxkämpfer jagen Viktor über den Sylter Deich! \U0001f600 é  tail"), (10, "a\x1cb it's IT'S don't 12 345 <|endoftext|> <|startoftext|>x y"),
]


@pytest.fixture(scope="session")
def awkward():
    return list(AWKWARD)
