import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, _row int, fp string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of given texts (or of rows doc_id, text, lang, source), with extra columns of clashing names."""

    def make(rows):
        full = [(i, r, "en", "s") if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        return spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 2, "y") for r in full], COLUMNS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    return [None, "", " ", "\n\n", "a", "word " * 20000, "Ünïcödé ßtraße 漢字 \U0001f600", "a", "x" * 50000, "one two three four five six seven eight nine ten eleven twelve"]


@pytest.fixture(scope="session")
def as_dict():
    def get(df, key="doc_id"):
        return {r[key]: r for r in df.collect()}

    return get


__all__ = ["F"]
