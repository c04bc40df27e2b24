import os

import pytest

from trialweave import session


class FakeContext:
    master = "spark://host:7077"


class FakeConf:
    def get(self, key, default=None):
        return default


class FakeSession:
    sparkContext = FakeContext()
    conf = FakeConf()


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession(), "step")


def test_job_folders_are_removed(spark):
    with session.job_folders(spark) as held:
        step = session.materialise(spark.range(5), "scope")
        assert step.count() == 5
        assert len(held) == 1 and os.path.isdir(held[0])
    assert not os.path.exists(held[0])


def test_local_session_keeps_one_scratch_folder(spark):
    first, second = (session.shared_dir(spark, "a"), session.shared_dir(spark, "b"))
    assert first != second
    assert os.path.dirname(first) == os.path.dirname(second)
