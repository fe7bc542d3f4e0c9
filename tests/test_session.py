import os

import pytest

from millrace import session


def test_what_is_saved_in_a_scratch_block_goes_with_it(spark):
    with session.scratch(spark):
        path = session.saved(spark.range(3), "x").inputFiles()[0]
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))


def test_release_removes_a_table(spark):
    kept = session.saved(spark.range(3), "x")
    path = kept.inputFiles()[0].removeprefix("file://")
    session.release(kept)
    assert not os.path.exists(path)


def test_a_cluster_must_name_the_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())
