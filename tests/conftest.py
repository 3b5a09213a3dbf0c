import pytest

from quillframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
