import pytest

from symbolmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield s
    s.stop()
