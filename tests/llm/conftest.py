import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k0 string, score double, h long, id long, s string"


@pytest.fixture
def make_docs(spark):
    """Documents with columns whose names operators could use themselves."""
    def make(rows):
        return spark.createDataFrame([(*r, None, "x", 0.5, 1, 2, "y") if len(r) == 4 else r for r in rows], DOCS)
    return make
