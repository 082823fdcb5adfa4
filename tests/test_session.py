import pytest

from equarry import session


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder
        self._jsc = self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return self.folder is not None

    def get(self):
        return self.folder


class Session:
    def __init__(self, master, folder=None, conf=None):
        self.sparkContext, self.values = Context(master, folder), conf or {}
        self.conf = self

    def get(self, key, default):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(session.NoSharedFolder):
        session.shared_folder(Session(master))


def test_setting_then_context_then_temporary():
    assert session.shared_folder(Session("yarn", "hdfs://c", {"spark.checkpoint.dir": "hdfs://a/"})) == "hdfs://a"
    assert session.shared_folder(Session("yarn", "hdfs://c")) == "hdfs://c"
    assert session.shared_folder(Session("local[2]")).startswith("file://")


def test_dropped_table_is_gone(spark):
    kept = session.materialize(spark.range(5).toDF("id"), "t")
    assert kept.count() == 5
    path = kept.inputFiles()[0].rpartition("/")[0]
    session.drop_table(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
