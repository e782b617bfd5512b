import pytest


@pytest.fixture(scope="session")
def sample():
    """The given tables at their smallest."""
    return "/root/testdata/sf0.001"
