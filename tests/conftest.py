import pytest

from gridloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "3g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
