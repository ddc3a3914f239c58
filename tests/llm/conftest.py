import pytest


@pytest.fixture(scope="module")
def docs(spark):
    def make(*rows, extra=""):
        return spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string" + extra)

    return make
