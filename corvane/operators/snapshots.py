"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import WHITE


def trimmed_lower(c: Column) -> Column:
    """Compare text without case and surrounding white space."""
    return F.regexp_replace(F.lower(c), f"^{WHITE}|{WHITE}$", "")


def snapshot_changes(
    df: DataFrame,
    key: str = "id",
    snapshot: str = "snapshot_no",
    version: str = "revision_ts",
    compare: dict[str, Column] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``(snapshot, key, change)`` with change 'added', 'removed' or 'changed', for each snapshot against the one before.

    1. Outdated and repeated rows go first: per snapshot and key the row with the latest ``version`` counts (null is the
       oldest; ties take the largest compared values). This aggregate combines before its shuffle, so a key that holds
       a third of all rows costs one row per input partition.
    2. The remaining rows, at most one per key and snapshot, are range-partitioned by key and sorted by key and snapshot.
       All snapshots share the boundaries, so a range holds the same slice of every snapshot.
    3. Each range is streamed once. The cursor of the earlier and that of the later snapshot advance together over the
       sorted run: a key whose neighbour is the same key in the next snapshot is compared, one without a neighbour was
       added or removed. No further shuffle is needed, as a range partitioning already clusters the keys.

    ``compare`` names the compared values (default: text_hash without case and surrounding white space); null equals
    null and differs from any value. Rows whose key or snapshot is null are no records of a snapshot and are left out.
    "The one before" is the preceding snapshot number that the table holds. An empty table gives no rows; the first
    snapshot gives none. Columns that are not named here are never read.
    """
    compare = compare or {"text_hash": trimmed_lower(F.col("text_hash"))}
    values = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(compare.values())])
    rows = df.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
    order = rows.select(F.col(snapshot).alias("_s")).distinct()
    by_number = Window.orderBy("_s")  # one row per snapshot
    order = order.select("_s", F.lag("_s").over(by_number).alias("_before"), F.lead("_s").over(by_number).alias("_after"))

    latest = rows.groupBy(F.col(snapshot).alias("_s"), F.col(key).alias("_k")).agg(F.max(F.struct(F.col(version).alias("v"), values.alias("x"))).alias("_r"))
    latest = latest.select("_s", "_k", F.col("_r.x").alias("_x"))
    ranged = latest.repartitionByRange(partitions, "_k") if partitions else latest.repartitionByRange("_k")
    run = Window.partitionBy("_k").orderBy("_s")
    seen = ranged.join(F.broadcast(order), "_s").select(
        "_s", "_k", "_x", "_before", "_after",
        F.lag("_s").over(run).alias("_ps"), F.lag("_x").over(run).alias("_px"), F.lead("_s").over(run).alias("_ns"),
    )
    met = F.col("_ps").eqNullSafe(F.col("_before"))
    here = F.when(F.col("_before").isNull(), None).when(~met, "added").when(~F.col("_x").eqNullSafe(F.col("_px")), "changed")
    gone = F.when(F.col("_after").isNotNull() & ~F.col("_ns").eqNullSafe(F.col("_after")), "removed")
    events = F.array(F.struct(F.col("_s").alias("s"), here.alias("change")), F.struct(F.col("_after").alias("s"), gone.alias("change")))
    return seen.select("_k", F.explode(F.filter(events, lambda e: e["change"].isNotNull())).alias("e")).select(F.col("e.s").alias(snapshot), F.col("_k").alias(key), F.col("e.change").alias("change"))
