import pytest

from driftwell import session


class Fake:
    def __init__(self, master, checkpoint=None):
        self.conf, self.held = self, {"spark.checkpoint.dir": checkpoint}
        self.sparkContext = self
        self.master = master

    def get(self, key, default=None):
        return self.held.get(key) or default


def test_a_cluster_must_name_its_shared_folder():
    assert session.shared_dir(Fake("local[4]"), "x").startswith("file:///tmp/checkpoints/driftwell/driftwell/x-")
    assert session.shared_dir(Fake("yarn", "hdfs://n/c/"), "x").startswith("hdfs://n/c/driftwell/x-")
    for master in ("yarn", "spark://n:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Fake(master), "x")


def test_stored_tables_can_be_deleted(spark):
    path = session.shared_dir(spark, "gone")
    assert session.stored(spark.range(3), "gone", path=path).count() == 3
    session.delete(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()
