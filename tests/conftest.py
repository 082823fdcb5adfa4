import pytest

from equarry.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    return s
