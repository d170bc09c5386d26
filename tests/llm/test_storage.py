import pytest

from cuemill.llm import storage


class Stub:
    """A session that names no shared folder."""

    def __init__(self, master):
        self.sparkContext, self.conf, self.master, self.applicationId = self, self, master, f"app-{master}"

    def getConf(self):
        return self

    def get(self, key, default=None):
        return default

    def setCheckpointDir(self, path):
        self.path = path


def test_only_local_masters_may_name_no_folder():
    local = Stub("local[2]")
    assert storage.shared_root(local) == storage.shared_root(local) == local.path
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            storage.shared_root(Stub(master))


def test_named_folder(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert storage.new_folder(spark, "x").startswith(f"{root}/x-")
    assert storage.materialise(spark.range(3), "x").count() == 3


def test_removed_table_and_settings(spark):
    before = spark.conf.get(storage.CLEAN_UP, None)
    table = storage.materialise(spark.range(100).groupBy("id").count(), "x")
    assert table.count() == 100 and spark.conf.get(storage.CLEAN_UP, None) == before
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    storage.remove_table(table)
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)
