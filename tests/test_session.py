import pytest

from tickertide.session import shared_dir


class FakeSession:
    """Stands for a session on a cluster; only the two settings are asked for."""

    def __init__(self, master: str, folder: str | None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(FakeSession(master, None))
    assert shared_dir(FakeSession("yarn", "hdfs://x/y/")) == "hdfs://x/y"
