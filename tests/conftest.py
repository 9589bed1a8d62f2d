import pytest

from seriesloom.operators import catalog as cat
from tests.support import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def catalog(spark):
    return cat.seed_catalog(spark)
