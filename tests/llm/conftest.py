import pytest

from tests.llm import helpers


@pytest.fixture(scope="session")
def docs(spark):
    return helpers.awkward(spark).cache()


@pytest.fixture(scope="session")
def none(spark):
    return helpers.empty(spark)


@pytest.fixture(scope="session")
def sample(spark):
    """Documents and labels of the smallest test tables."""
    folder = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(
        f"{folder}/labels.parquet"
    )
