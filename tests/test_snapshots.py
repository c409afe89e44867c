from datetime import datetime

from pyspark.sql import functions as F

from corvane.operators.snapshots import snapshot_changes

SHAPE = "snapshot_no int, id string, text_hash string, revision_ts timestamp, _k string, c0 string"


def at(n):
    return datetime(2024, 1, n)


def test_changes(spark, rows):
    data = [
        (1, "same", "A", at(1), "", ""), (2, "same", " a\n", at(1), "x", "y"),
        (1, "gone", "b", at(1), "", ""), (2, "new", "c", None, "", ""),
        (1, "moved", "d", at(1), "", ""), (2, "moved", "old", None, "", ""), (2, "moved", "e", at(3), "", ""), (2, "moved", "old", at(2), "", ""),
        (1, "null", None, at(1), "", ""), (2, "null", None, at(2), "", ""), (1, "tonull", "f", at(1), "", ""), (2, "tonull", None, at(1), "", ""),
        (1, "back", "g", at(1), "", ""), (4, "back", "h", at(1), "", ""), (2, None, "x", at(1), "", ""), (None, "x", "x", at(1), "", ""), (4, "same", "a", at(1), "", ""),
    ]
    df = spark.createDataFrame(data, SHAPE)
    expected = sorted(
        [(2, "gone", "removed"), (2, "new", "added"), (2, "moved", "changed"), (2, "tonull", "changed"), (2, "back", "removed"),
         (4, "back", "added"), (4, "new", "removed"), (4, "moved", "removed"), (4, "null", "removed"), (4, "tonull", "removed")], key=str)
    assert rows(snapshot_changes(df)) == expected
    assert rows(snapshot_changes(df.union(df).repartition(7), partitions=3)) == expected


def test_ties_empty_and_hot_keys(spark, rows):
    tie = spark.createDataFrame([(1, "a", "x", at(1), "", ""), (2, "a", "x", at(1), "", ""), (2, "a", "y", at(1), "", "")], SHAPE)
    assert rows(snapshot_changes(tie)) == [(2, "a", "changed")]  # the larger value counts
    assert snapshot_changes(tie.limit(0)).count() == 0
    assert snapshot_changes(tie.where("snapshot_no = 1")).count() == 0
    hot = tie.join(spark.range(2000).select(F.col("id").alias("n"))).drop("n")
    assert rows(snapshot_changes(hot)) == [(2, "a", "changed")]


def test_other_columns_can_be_compared(spark, rows):
    df = spark.createDataFrame([(1, "a", "x", at(1), "p", ""), (2, "a", "x", at(1), "q", "")], SHAPE)
    assert rows(snapshot_changes(df, compare={"k": F.col("_k")})) == [(2, "a", "changed")]
