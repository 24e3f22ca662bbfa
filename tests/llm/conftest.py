import pytest
from text_samples import clashing, documents


@pytest.fixture
def docs(spark):
    return clashing(documents(spark))


@pytest.fixture
def empty(spark):
    return clashing(documents(spark)).where("false")


@pytest.fixture
def doubled(docs):
    """Every row twice."""
    return docs.unionAll(docs)
