import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 string, cid long, tk string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from quillspark.shipping import ship_package

    ship_package(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) with extra columns whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 1, "y") for r in rows], DOCS)

    return make
