import pytest

from assayloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("assayloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
