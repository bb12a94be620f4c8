import pytest

from quillspark.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(4, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
