import pytest


@pytest.fixture
def docs(spark):
    """Builds a documents table; columns may be given and named freely."""

    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long", parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return build
