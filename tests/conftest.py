import pytest

from lumenact.session import local_session
from tests.compare import connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    return connect(SF)
