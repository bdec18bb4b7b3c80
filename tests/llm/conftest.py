import pytest

#: Columns of documents, and some whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, shard int, before long, fp long, kept boolean, host string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    long = "\n".join(" ".join(f"word{(i * 7 + j) % 977}" for j in range(40)) for i in range(400))
    texts = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "two words"), (6, long), (7, long), (8, long + " more"), (8, "same id"), (None, "no id"), (None, None), (9, "é漢字 🙂 tail"), (9, "é漢字 🙂 tail")]
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 2}", None, None, None, None, None, None, None, None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, 0), (None, 1, None), (9, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
