"""The folder of intermediate tables."""

import types

import pytest

from galley.llm import common


def session(master, setting):
    conf = types.SimpleNamespace(get=lambda key, default: setting)  # a running session takes no new spark.checkpoint.dir
    return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, applicationId="app-1"))


def test_the_clusters_folder_is_used():
    assert common.shared_dir(session("spark://x", "hdfs:///shared")) == "hdfs:///shared/galley-app-1"


def test_without_the_setting_only_one_process_runs():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://x", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("local-cluster[2,1,1000]", None))
    own = common.shared_dir(session("local[4]", None))
    assert own.startswith("file:///") and own == common.shared_dir(session("local[4]", ""))
