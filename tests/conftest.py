import pytest

from quillspark.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
