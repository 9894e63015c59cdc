import pytest

from tabsynth.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, "4g", **{"spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri()})
    yield session
    session.stop()
