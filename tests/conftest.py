import pytest

from signalbed.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("signalbed-tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    return session
