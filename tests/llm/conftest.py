import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text), with columns whose names the operators use inside."""

    def build(rows):
        df = spark.createDataFrame([(i, t, "x", 1, "y", 2.0) for i, t in rows], "doc_id long, text string, root string, set int, hit string, key double")
        return df

    return build


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
