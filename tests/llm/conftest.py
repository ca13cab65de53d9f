import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASH = "id k text_1 score words fp w0 key cell side spans start end n h seed at item label y kind base sequence_id offset component_id predicted held_out own first".split()


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls everywhere, empty and blank texts, one very long text, ties, repeated rows, clashing columns."""
    rows = [
        (1, "The first text holds a handful of plain words."), (2, ""), (3, None), (None, "A text without an id."), (None, None), (4, " \n\t "), (5, "word"),
        (6, "The first text holds a handful of plain words."), (6, "The first text holds a handful of plain words."), (6, "Another text under the same id, quite different from it."),
        (7, "long " * 30_000 + "\nend"), (8, "é日本語 🙂 naïve ﬁ\x00\x1c\x85 x"), (9, "A" * 20_000), (-1, "negative id, text of its own"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="session")
def no_docs(nasty):
    return nasty.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
