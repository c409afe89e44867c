"""Queries of the general data problems (1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators.snapshots import snapshot_changes
from corvane.operators.timestamps import normalise_timestamps
from corvane.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_timestamps(read(spark, d, "feed_items"), read(spark, d, "sources"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(read(spark, d, "ledger_snapshots"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found}

SQL = {
    "p4_found": r"""
        WITH latest AS (
          SELECT snapshot_no, id, regexp_replace(lower(text_hash), '^\s+|\s+$', '', 'g') AS h
          FROM ledger_snapshots WHERE id IS NOT NULL AND snapshot_no IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY snapshot_no, id ORDER BY revision_ts DESC NULLS LAST, h DESC NULLS LAST) = 1
        ), pairs AS (
          SELECT coalesce(b.snapshot_no, a.snapshot_no + 1) AS snapshot_no, coalesce(b.id, a.id) AS id,
                 CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed'
                      WHEN a.h IS DISTINCT FROM b.h THEN 'changed' END AS change
          FROM latest a FULL JOIN latest b ON a.id = b.id AND b.snapshot_no = a.snapshot_no + 1
        )
        SELECT snapshot_no, id, change FROM pairs
        WHERE change IS NOT NULL AND snapshot_no > (SELECT min(snapshot_no) FROM ledger_snapshots)
          AND snapshot_no <= (SELECT max(snapshot_no) FROM ledger_snapshots)""",
}
