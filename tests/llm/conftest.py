import pytest

from tests.llm.odd import no_docs, odd_docs


@pytest.fixture(scope="session")
def odd(spark):
    return odd_docs(spark).cache()


@pytest.fixture(scope="session")
def none(spark):
    return no_docs(spark)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()
