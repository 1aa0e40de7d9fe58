from types import SimpleNamespace

import pytest

from tidemark.llm.common import shared_dir


def session(master, named=None):
    conf = SimpleNamespace(get=lambda key, default: named or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_named_folder_is_used_everywhere():
    for master in ("local[4]", "spark://host:7077"):
        assert shared_dir(session(master, "hdfs://host/shared/"), "sets").startswith("hdfs://host/shared/sets-")


def test_local_session_without_a_folder_keeps_one_of_its_own():
    for master in ("local", "local[*]", "local[4, 2]"):
        one, two = (shared_dir(session(master), "sets") for _ in range(2))
        assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]


def test_cluster_without_a_folder_is_refused():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master), "sets")
