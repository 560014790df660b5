import pytest

from siftlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus=4, shuffle=4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
