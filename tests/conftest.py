import pytest

from gridpulse.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, shuffle_partitions=4)
