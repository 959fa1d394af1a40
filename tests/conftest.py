import pytest

from wardflow.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "wardflow-tests", "8g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    if session.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
