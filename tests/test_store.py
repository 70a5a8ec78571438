"""Where intermediate tables go."""

import os
from types import SimpleNamespace

import pytest

from rillstone.store import Scratch, shared_dir


def session(master, conf=None, set_dir=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: set_dir)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf or d), sparkContext=context)


def test_the_named_folder_is_taken():
    assert shared_dir(session("spark://host:7077", conf="hdfs:///x")) == "hdfs:///x"
    assert shared_dir(session("yarn", set_dir="hdfs:///y")) == "hdfs:///y"


def test_a_cluster_without_folder_is_refused():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))


def test_local_runs_get_one_folder():
    a = shared_dir(session("local[4]"))
    assert os.path.isdir(a) and shared_dir(session("local[4]")) == a and shared_dir(session("local")) != a


def test_tables_are_kept_and_dropped(spark):
    scratch = Scratch(spark)
    one, two = scratch.keep(spark.range(3)), scratch.keep(spark.range(5))
    assert one.count() == 3 and two.count() == 5
    paths = [path for _, path in scratch.paths.values()]
    assert len(paths) == 2 and all(os.path.isdir(p) for p in paths)
    scratch.drop(one, spark.range(1))
    assert not os.path.exists(paths[0]) and two.count() == 5
    scratch.clear()
    assert not os.path.exists(paths[1]) and not scratch.paths
