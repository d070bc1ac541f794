import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text) pairs, with a column that clashes with the operators' own names."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, length string"
        full = [(i, t, None, None, None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make
