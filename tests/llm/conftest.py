import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with an extra column whose name an operator also uses."""
    def make(rows, schema=DOCS):
        full = [tuple(r) + ("en", "s0", len(r[1] or ""))[: 5 - len(r)] for r in rows]
        return spark.createDataFrame(full, schema)
    return make
