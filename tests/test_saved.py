"""Saved tables: where they lie, and that they can be deleted."""

import os
from types import SimpleNamespace

import pytest

from lithic import saved


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        saved.shared_dir(session)


def test_tables_lie_in_the_application_s_folder(spark):
    one, two = saved.save(spark.range(5), "one"), saved.save(spark.range(7), "two")
    folder = saved.shared_dir(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and spark.sparkContext.applicationId in folder
    assert all(folder in path for path in [*one.inputFiles(), *two.inputFiles()])
    before = {name for name in os.listdir(folder.removeprefix("file:"))}
    saved.drop_saved(one)
    assert len(before - set(os.listdir(folder.removeprefix("file:")))) == 1 and two.count() == 7
