import pytest

SCHEMA = "text string, lang string, doc_id long, keys int, uid string, node string, n long, kept string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of documents with extra columns, some of which clash with names inside operators."""

    def make(rows):
        return spark.createDataFrame([(t, "en", i, 7, "u", "n", 3, "k") for i, t in rows], SCHEMA)

    return make
