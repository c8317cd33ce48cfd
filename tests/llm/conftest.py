import pytest
from pyspark.sql import types as T

#: documents, with columns that clash with names used inside the operators.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("key", "size", "hash", "fp", "shard", "row", "member", "words", "count", "item_id", "starts")])


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text[, source[, lang]]) rows."""

    def build(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None, *(["x"] * 11)) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while nine small birds sing a song of spring"


@pytest.fixture(scope="session")
def edge_rows():
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "!!! ???"), (6, PASSAGE), (7, "Intro here. " + PASSAGE + " and more"), (8, PASSAGE.upper()),
        (9, LONG), (10, LONG), (11, "É ü ß\x0bline"), (11, "É ü ß\x0bline"), (None, PASSAGE), (None, "lonely text"), (12, None, None, None), (13, "a b\na b\na b", None),
    ]
