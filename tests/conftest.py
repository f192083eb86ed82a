import pytest

from cuesheet.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("cuesheet-tests", master="local[8]", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
