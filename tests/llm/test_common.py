from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millrace.llm import common


def session(master, conf=None, checkpoint=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint, setCheckpointDir=lambda folder: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: conf or other), sparkContext=context)


def test_only_a_single_process_may_use_a_folder_of_its_machine():
    assert common.shared_folder(session("local[4]")) and common.shared_folder(session("local"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(session(master))
        assert common.shared_folder(session(master, conf="hdfs://shared")) == "hdfs://shared"
        assert common.shared_folder(session(master, checkpoint="hdfs://own")) == "hdfs://own"


@pytest.mark.parametrize("bits", [1 << 6, 1 << 10, 1 << 23])
def test_bitmap_has_every_key_and_a_bounded_size(spark, bits):
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k"))
    marks = common.bitmap(keys, "k", bits)
    assert marks.count() <= bits // 64
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("mask"))
    got = {int(r["k"]): r["on"] for r in common.marked(rows, "k", marks, bits, "on").collect()}
    assert len(got) == 3000 and all(got[i] for i in range(0, 3000, 3))
    if bits == 1 << 23:
        assert sum(got.values()) < 1100


def test_ascii_lower(spark):
    rows = spark.createDataFrame([("ABZ [é É İ",), ("PLAIN aZ",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(common.ascii_lower(F.col("t"))).collect()] == ["abz [é É İ", "plain az", "", None]
