import os

import pytest

from tessera.sources import shared


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    def __init__(self, conf=None, context=None, master="local[2]"):
        self.conf = Conf(conf or {})
        self.sparkContext = type("C", (), {"applicationId": "app-7", "master": master, "getCheckpointDir": lambda self: context})()


def test_folders():
    assert shared.shared_folder(Fake({"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert shared.shared_folder(Fake(context="/c")) == "/c"
    assert shared.shared_folder(Fake()) == shared.shared_folder(Fake())
    assert shared.fresh_path(Fake(context="/c"), "n") != shared.fresh_path(Fake(context="/c"), "n")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_clusters_need_a_folder(master):
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_folder(Fake(master=master))
    assert shared.shared_folder(Fake(context="/c", master=master)) == "/c"


def test_scratch(spark):
    undone = []
    with shared.scratch():
        outer = shared.fresh_path(spark, "outer")
        spark.range(3).write.parquet(outer)
        with pytest.raises(ZeroDivisionError), shared.scratch():
            inner = shared.fresh_path(spark, "inner")
            spark.range(3).write.parquet(inner)
            shared.undo_later(lambda: undone.append(1))
            1 / 0  # noqa: B018
        assert undone and not os.path.exists(inner) and spark.read.parquet(outer).count() == 3
    kept = shared.fresh_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    assert not os.path.exists(outer) and os.path.exists(kept)
