import pytest

from tessera.schema import pick
from tessera.session import clear_scratch, cut_lineage, materialize, scratch_path, shared_dir
from tessera.sources.files import path_exists
from tessera.utils import Timer, flatten


class Fake:
    """A session with just the settings that shared_dir reads."""

    def __init__(self, named=None, master="spark://host:7077", checkpoint=None):
        self.conf = self
        self.sparkContext = self
        self.named, self.master, self.checkpoint = named, master, checkpoint

    def get(self, key, default):
        return self.named or default

    def getCheckpointDir(self):
        return self.checkpoint


def test_shared_dir_follows_the_session():
    assert shared_dir(Fake("hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(Fake(checkpoint="hdfs://x/z")) == "hdfs://x/z"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(Fake(master=master))


def test_materialised_tables_and_clearing(spark, rows):
    df = materialize(spark.range(5).selectExpr("id", "id * 2 as twice"), "t")
    assert rows(df) == [(i, 2 * i) for i in range(5)]
    assert rows(cut_lineage(spark.range(3))) == [(0,), (1,), (2,)]
    root = scratch_path(spark, "x").rsplit("/", 1)[0]
    assert path_exists(spark, root)
    clear_scratch(spark)
    assert not path_exists(spark, root)


def test_pick_ignores_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Src long, src long, SRC long")
    assert pick(df, "src").first()[0] == 2
    assert pick(df, "sRC").first()[0] == 1
    with pytest.raises(ValueError, match="missing column"):
        pick(df, "dst")


def test_helpers():
    timer = Timer()
    with timer:
        pass
    assert timer.seconds > 0 and list(flatten([1, [2, (3, [])], 4])) == [1, 2, 3, 4]
