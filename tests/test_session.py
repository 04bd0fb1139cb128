import math

import pytest
from pyspark.sql import functions as F

from cohortlens import session as S


def test_pin_broadcasts_small_and_stores_large(spark, monkeypatch):
    small = S.pin(spark.range(3))
    assert sorted(r[0] for r in small.collect()) == [0, 1, 2]
    monkeypatch.setattr(S, "PIN_ROWS", 2)
    large = S.pin(spark.range(3))
    assert sorted(r[0] for r in large.collect()) == [0, 1, 2]
    assert S.shared_dir(spark).split(":")[-1] in large.inputFiles()[0]


def test_pin_checks_bytes_too(spark, monkeypatch):
    monkeypatch.setattr(S, "PIN_BYTES", 100)
    wide = spark.range(2).withColumn("text", F.repeat(F.lit("x"), 1000))
    assert S.pin(wide).inputFiles()


def test_pin_fetches_few_wide_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "PIN_BYTES", 10_000)
    assert not S.pin(spark.range(9), row_bytes=1000).inputFiles()
    assert S.pin(spark.range(11), row_bytes=1000).inputFiles()


def test_attach_without_groups_keeps_values_exact(spark):
    one = spark.createDataFrame(
        [([0.1, 1 / 3, float("inf"), -1e-300, float("nan")], 2**62, None)],
        "a array<double>, b bigint, c string",
    )
    row = S.attach(spark.range(1), one, []).first()
    assert row["a"][:4] == [0.1, 1 / 3, float("inf"), -1e-300]
    assert math.isnan(row["a"][4])
    assert row["b"] == 2**62 and row["c"] is None


class Stub:
    """A session with given settings."""

    def __init__(self, master, named=None, current=None):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master = master
        self.current = current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


def test_shared_dir_is_the_one_the_session_names():
    assert S.shared_dir(Stub("yarn", "hdfs://a/b/")) == "hdfs://a/b"
    assert S.shared_dir(Stub("yarn", "hdfs://a/b", "hdfs://c")) == "hdfs://a/b"
    assert S.shared_dir(Stub("yarn", None, "hdfs://c/")) == "hdfs://c"
    assert S.scratch_path(Stub("yarn", "hdfs://a"), "x").startswith("hdfs://a/x-")


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        S.shared_dir(Stub("yarn"))
    assert "cohortlens-" in S.shared_dir(Stub("local[2]"))
