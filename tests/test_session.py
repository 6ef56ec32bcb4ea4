import pytest

from pulse import session


class Conf(dict):
    pass


@pytest.fixture(autouse=True)
def no_jvm(monkeypatch):
    """The stand-in session has no JVM that could clean up at its end."""
    monkeypatch.setattr(session, "_delete_at_end", lambda spark, path: None)


class FakeSession:
    """Only what the folder lookup asks of a session."""

    def __init__(self, master, folder=None):
        self.conf = Conf({"spark.checkpoint.dir": folder} if folder else {})
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})()


def test_the_named_folder_wins():
    assert session.shared_dir(FakeSession("yarn", "hdfs://shared/x")) == "hdfs://shared/x"
    path = session.scratch_path(FakeSession("yarn", "hdfs://shared/x"), "stage")
    assert path.startswith("hdfs://shared/x/stage-")


def test_a_cluster_never_falls_back_to_a_local_folder():
    with pytest.raises(ValueError):
        session.shared_dir(FakeSession("spark://host:7077"))


def test_a_local_session_keeps_one_folder():
    local = FakeSession("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)
    assert session.scratch_path(local, "a") != session.scratch_path(local, "a")
