import pytest

from foldwise.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("foldwise-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
