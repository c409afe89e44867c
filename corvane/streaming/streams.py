"""Structured Streaming over the event journal: windows, sessions, rolling dedup, triggers and idempotent ledger batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.operators.ledger import VersionedTable, merge_ledger
from corvane.session import exists


def journal_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """Files of a journal in the order in which they came."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: tuple[str, ...], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and value sums in tumbling or sliding windows; rows later than ``late`` are dropped once their window is closed."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), *by, "events", "total")


def sessions(events: DataFrame, ts: str, by: tuple[str, ...], gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of events that are no further apart than ``gap``."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), *by, "events")


def first_within(events: DataFrame, ts: str, keys: list[str], window: str) -> DataFrame:
    """The first event of each key within a rolling window; state older than the window is dropped."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, checkpoint: str, to: str | None = None, mode: str = "append", name: str | None = None, batch: Callable[[DataFrame, int], None] | None = None, timeout: int = 600) -> None:
    """Process what there is and stop. The sink is a folder, a table in memory, or a function of each batch."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if batch is not None:
        query = writer.foreachBatch(batch).start()
    elif name is not None:
        query = writer.format("memory").queryName(name).start()
    else:
        query = writer.format("parquet").option("path", to).start()
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError(f"the stream did not end within {timeout} s")
    finally:
        query.stop()


def ledger_batches(table: VersionedTable, empty: DataFrame, now: Callable[[int], Column]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that merges each batch into a versioned ledger. A batch that comes again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        prior = table.read()
        merged = merge_ledger(empty if prior is None else prior, batch, now(number)).drop("changed")
        table.commit(merged)

    return merge


def trigger_batches(spark: SparkSession, path: str, event: str, source: str | None, fire: Callable[[int], None], cursor: int = 0) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that fires once a batch for the first matching event after its cursor.

    The cursor lies in ``path``, one folder for each batch that fired, so that a restart goes on where it stood and a batch
    that comes again doesn't fire again once its cursor is written.
    """
    from corvane.operators.planning import match_trigger

    def stand() -> int:
        return max(cursor, spark.read.parquet(path).agg(F.max("seq")).first()[0] or 0) if exists(spark, path) else cursor

    def look(batch: DataFrame, number: int) -> None:
        hit = match_trigger(batch, stand(), event, source).collect()  # at most one row
        if hit:
            fire(hit[0]["seq"])
            spark.createDataFrame([(hit[0]["seq"],)], "seq bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return look


def band_batches(store_path: str, day: Column, window_days: int, found: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Rolling near-duplicate detection: each batch meets the bands of the last days, then adds those of its kept documents.

    Batches have ``id, text, ordinal``. The band store is parquet partitioned by day and batch: pruning it is a partition
    filter, and a batch that comes again overwrites its own part and doesn't meet it.
    """
    from corvane.operators.dedup import band_pairs, greedy_duplicates, signature_bands

    def look(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bands = signature_bands(batch, "id", "text", ("ordinal",))
        known = spark.createDataFrame([], "id string, duplicate_of string")
        if exists(spark, store_path):
            store = spark.read.parquet(store_path).where((F.col("day") >= F.date_sub(day, window_days)) & (F.col("batch") < number))
            old = store.join(bands.select("band", "value").distinct(), ["band", "value"], "left_semi")
            known = bands.join(old.select("band", "value", F.col("id").alias("old")), ["band", "value"]).where("id <> old").groupBy("id").agg(F.min("old").alias("duplicate_of"))
        fresh = bands.join(known, "id", "left_anti")
        within = greedy_duplicates(band_pairs(fresh, "id", "ordinal"))
        found(known.unionByName(within), number)
        kept = fresh.join(within, "id", "left_anti").select("id", "band", "value", day.alias("day"), F.lit(number).alias("batch"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(store_path)

    return look
