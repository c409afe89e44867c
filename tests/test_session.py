import os

import pytest
from pyspark.sql import functions as F

from corvane.session import Scratch, at_most, bounded_rows, broadcast_if_small, least_hashed, shared_dir, squeeze


def test_scratch_survives_and_goes(spark, rows):
    s = Scratch(spark, "x")
    kept = s.keep(spark.range(5), "t")
    assert s.base.startswith(shared_dir(spark)) and rows(kept) == [(k,) for k in range(5)]
    path = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    s.drop(kept)
    assert not os.path.exists(path)
    s.keep(spark.range(0), "empty")
    s.drop()
    assert not os.path.exists(s.base.removeprefix("file://"))


def test_bounds(spark):
    assert at_most(spark.range(3), 3) and not at_most(spark.range(4), 3)
    assert len(bounded_rows(spark.range(3), 3, "x")) == 3
    with pytest.raises(ValueError, match="documented bound"):
        bounded_rows(spark.range(4), 3, "x")
    hint = lambda n: "broadcast" in broadcast_if_small(spark.range(5), n)._jdf.queryExecution().logical().toString()
    assert hint(5) and not hint(4)
    got = least_hashed(spark.range(100), F.xxhash64("id"), 7)
    assert got.count() == 7 and least_hashed(spark.range(0), F.xxhash64("id"), 7).count() == 0


def test_white_space(spark):
    assert spark.createDataFrame([(" A  b\n\x1c",)], "t string").select(squeeze(F.col("t"))).first()[0] == "a b"
