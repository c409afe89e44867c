"""The document ledger: classification of incoming documents, merges, tombstones and a versioned table without MERGE.

A merge is a function of two DataFrames (prior, incoming) that returns the whole new state by one full outer join on the
key; ``VersionedTable`` writes it beside the old version and then turns a pointer file.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import is_blank

#: States of a document; body columns that don't count as metadata.
STAGED, EMBEDDING, SEARCHABLE, FAILED, DUPLICATE, EMPTY, DELETED = "staged", "embedding", "searchable", "failed", "duplicate", "empty", "deleted"
BODY_COLUMNS = ("text", "abstract", "story_text")


def metadata_hash(source: Column, **columns: Column) -> Column:
    """Hash of the staged columns in order of their names, bodies and nulls left out."""
    named = [c.cast("string").alias(n) for n, c in sorted(columns.items()) if n not in BODY_COLUMNS]
    return F.sha2(F.to_json(F.struct(source.alias("_source"), *named)), 256)


def status_of(deleted: Column, duplicate_of: Column, text: Column) -> Column:
    """deleted over duplicate over empty over staged."""
    return F.when(deleted, DELETED).when(duplicate_of.isNotNull(), DUPLICATE).when(is_blank(text), EMPTY).otherwise(STAGED)


def stage_actions(incoming: DataFrame, prior: DataFrame, key: str = "id") -> DataFrame:
    """``incoming`` (key, status, text_hash, metadata_hash) with ``action``: write, ledger or skip.

    Deleted documents touch only the ledger; duplicates and empty ones only where something changed or the ledger had
    another status; others are written where text or metadata changed or they aren't searchable yet.
    """
    old = prior.select(F.col(key), F.col("text_hash").alias("_text"), F.col("metadata_hash").alias("_meta"), F.col("status").alias("_status"))
    rows = incoming.join(old, key, "left")
    changed = ~F.col("text_hash").eqNullSafe(F.col("_text")) | ~F.col("metadata_hash").eqNullSafe(F.col("_meta"))
    idle = F.coalesce(F.col("_status").isin(DUPLICATE, EMPTY), F.lit(False))
    action = (
        F.when(F.col("status") == DELETED, "ledger")
        .when(F.col("status").isin(DUPLICATE, EMPTY), F.when(changed | ~idle, "ledger").otherwise("skip"))
        .when(changed | ~F.col("_status").eqNullSafe(F.lit(SEARCHABLE)), "write").otherwise("skip")
    )
    return rows.withColumn("action", action).drop("_text", "_meta", "_status")


def merge_ledger(prior: DataFrame, incoming: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """New ledger from (key, url, title, text_hash, metadata_hash, status) rows.

    A row changes only where one of these differs (null-safe). A change of metadata alone keeps ``searchable``; the model
    and time of indexing stay with the text they belong to. Rows that aren't mentioned stay as they are.
    """
    columns = ["url", "title", "text_hash", "metadata_hash", "status"]
    old = prior.select(key, *[F.col(c).alias(f"o_{c}") for c in columns], "created_at", "updated_at", "embedded_model", "indexed_at", F.lit(True).alias("_old"))
    new = incoming.select(key, *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("_new"))
    rows = old.join(new, key, "full")
    had, has = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    same_text = F.col("o_text_hash").eqNullSafe(F.col("n_text_hash"))
    stays = (F.col("n_status") == STAGED) & (F.col("o_status") == SEARCHABLE) & same_text
    status = F.when(F.coalesce(stays, F.lit(False)), F.lit(SEARCHABLE)).otherwise(F.col("n_status"))
    differs = F.lit(False)
    for c in columns[:-1]:
        differs = differs | ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    moved = has & (~had | differs | ~F.col("o_status").eqNullSafe(status))
    pick = lambda c: F.when(moved, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    return rows.select(
        key, *[pick(c) for c in columns[:-1]], F.when(moved, status).otherwise(F.col("o_status")).alias("status"), F.when(had, F.col("created_at")).otherwise(now).alias("created_at"),
        F.when(moved, now).otherwise(F.col("updated_at")).alias("updated_at"), "embedded_model", "indexed_at", moved.alias("changed"),
    )


def index_queues(ledger: DataFrame) -> DataFrame:
    """``(id, queue)``: delete (indexed but gone), refresh (only metadata moved on), embed (staged)."""
    queue = (
        F.when(F.col("status").isin(DELETED, DUPLICATE, EMPTY) & F.col("indexed_at").isNotNull(), "delete")
        .when((F.col("status") == SEARCHABLE) & ~F.col("metadata_hash").eqNullSafe(F.col("indexed_metadata_hash")), "refresh")
        .when(F.col("status") == STAGED, "embed")
    )
    return ledger.select("id", queue.alias("queue")).where(F.col("queue").isNotNull())


def tombstone_missing(prior: DataFrame, present: DataFrame, key: str = "id", scope: tuple[str, ...] = ("source",), refuse_empty: bool = True) -> DataFrame:
    """``prior`` with the status deleted for rows of a covered scope that ``present`` (scope, key, truncated) doesn't hold.

    Only scopes that were covered count. A scope whose census was cut off is left alone, an empty one too while
    ``refuse_empty``; a covered scope without documents has one row with a null key.
    """
    census = present.groupBy(*scope).agg(F.bool_or(F.coalesce("truncated", F.lit(False))).alias("_cut"), F.count(key).alias("_size"))
    open_ = census.where(~F.col("_cut") & ((F.col("_size") > 0) if refuse_empty else F.lit(True))).select(*scope, F.lit(True).alias("_open"))
    here = present.where(F.col(key).isNotNull()).select(*scope, key).distinct().withColumn("_here", F.lit(True))
    rows = prior.join(open_, list(scope), "left").join(here, [*scope, key], "left")
    gone = F.col("_open").isNotNull() & F.col("_here").isNull() & (F.col("status") != DELETED)
    return rows.withColumn("tombstoned", gone).withColumn("status", F.when(gone, DELETED).otherwise(F.col("status"))).drop("_open", "_here")


def coverage_guard(present: DataFrame, scope: tuple[str, ...] = ("source",)) -> DataFrame:
    """``(scope, documents, truncated, verdict)``: whether a census may prune: ok, empty or truncated."""
    out = present.groupBy(*scope).agg(F.count_distinct("id").alias("documents"), F.bool_or(F.coalesce("truncated", F.lit(False))).alias("truncated"))
    return out.withColumn("verdict", F.when(F.col("truncated"), "truncated").when(F.col("documents") == 0, "empty").otherwise("ok"))


# --- state of units of work ------------------------------------------------------------------------------------------
def upsert_units(prior: DataFrame, incoming: DataFrame, mode: str = "merge", key: tuple[str, ...] = ("store", "unit_key")) -> DataFrame:
    """State of units after assertions (key, upstream, stage, attrs, delta); modes merge, increment and skip.

    merge: the token replaces the old one, a null stage keeps the old one, attributes are united and the new win.
    increment: ``delta`` (numbers by name) is summed over all assertions and added to the attributes, then ``attrs`` is laid
    over; an attribute that is no number is an error. skip: only units that aren't there yet come in. Every unit that an assertion touches is pending again. Several
    assertions of a unit count in the order of ``ordinal``: later attributes win.
    """
    if mode not in ("merge", "increment", "skip"):
        raise ValueError(f"unknown mode {mode}")
    none = F.create_map().cast("map<string,string>")
    said = F.sort_array(F.collect_list(F.struct("ordinal", F.map_entries(F.coalesce("attrs", none)).alias("pairs"))))  # assertions of one unit in one batch
    last = incoming.groupBy(*key).agg(
        F.max_by("upstream", "ordinal").alias("_upstream"), F.aggregate(said, none, lambda m, x: _over(m, F.map_from_entries(x["pairs"]))).alias("_attrs"),
        F.max_by("stage", F.when(F.col("stage").isNotNull(), F.col("ordinal"))).alias("_stage"),
    )
    new = last.select(*key, F.col("_upstream").alias("n_upstream"), F.col("_stage").alias("n_stage"), F.col("_attrs").alias("n_attrs"), F.lit(True).alias("_new"))
    if mode == "increment":
        sums = incoming.select(*key, F.explode("delta").alias("_name", "_by")).groupBy(*key, "_name").agg(F.sum("_by").alias("_by"))
        sums = sums.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_by"))).alias("_delta"))
        new = new.join(sums, list(key), "left")
    old = prior.select(*key, F.col("upstream").alias("o_upstream"), F.col("stage").alias("o_stage"), F.col("attrs").alias("o_attrs"), F.col("status").alias("o_status"), F.lit(True).alias("_old"))
    rows = old.join(new, list(key), "full")
    touched = F.col("_new").isNotNull() & (F.col("_old").isNull() if mode == "skip" else F.lit(True))
    base = F.col("o_attrs")
    if mode == "increment":
        old_value = lambda name: F.try_element_at(F.col("o_attrs"), name)
        wrong = lambda name: F.raise_error(F.concat(F.lit("increment of an attribute that is no number: "), name)).cast("double")
        number = lambda name: F.when(old_value(name).isNull(), 0.0).otherwise(F.coalesce(old_value(name).try_cast("double"), wrong(name)))
        added = F.transform_values(F.coalesce("_delta", F.create_map().cast("map<string,double>")), lambda k, v: (number(k) + v).cast("string"))
        base = _over(base, added)
    return rows.select(
        *key, F.when(touched, F.col("n_upstream")).otherwise(F.col("o_upstream")).alias("upstream"), F.when(touched, F.coalesce("n_stage", "o_stage")).otherwise(F.col("o_stage")).alias("stage"),
        F.when(touched, _over(base, F.col("n_attrs"))).otherwise(F.col("o_attrs")).alias("attrs"), F.when(touched, F.lit("pending")).otherwise(F.col("o_status")).alias("status"),
    )


def _over(a: Column, b: Column) -> Column:
    """Union of two maps in which the second wins; null counts as empty."""
    none = F.create_map().cast("map<string,string>")
    x, y = F.coalesce(a, none), F.coalesce(b, none)
    return F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y)


def advance_watermarks(units: DataFrame, finished: DataFrame, key: tuple[str, ...] = ("store", "unit_key")) -> DataFrame:
    """Units that a finished batch refers to have what was upstream as ingested, and are done."""
    done = finished.select(*key).distinct().withColumn("_done", F.lit(True))
    rows = units.join(done, list(key), "left")
    hit = F.col("_done").isNotNull()
    return rows.withColumn("ingested", F.when(hit, F.col("upstream")).otherwise(F.col("ingested"))).withColumn("status", F.when(hit, "done").otherwise(F.col("status"))).drop("_done")


def merge_repositories(prior: DataFrame, incoming: DataFrame) -> DataFrame:
    """Repositories by id: new values win where they aren't null, stars are added up, topics replaced unless empty.

    A name that another repository took over is kept by the new owner; the older row's name becomes ``name#stale:id``.
    """
    rows = prior.select("repo_id", *[F.col(c).alias(f"o_{c}") for c in ("full_name", "description", "stars", "topics", "star_events", "status")]).join(
        incoming.select("repo_id", *[F.col(c).alias(f"n_{c}") for c in ("full_name", "description", "stars", "topics", "star_events", "status")], F.lit(1).alias("_new")), "repo_id", "full"
    )
    pick = lambda c: F.coalesce(f"n_{c}", f"o_{c}").alias(c)
    topics = F.when(F.coalesce(F.size("n_topics"), F.lit(0)) > 0, F.col("n_topics")).otherwise(F.col("o_topics")).alias("topics")
    merged = rows.select("repo_id", pick("full_name"), pick("description"), pick("stars"), topics, (F.coalesce("o_star_events", F.lit(0)) + F.coalesce("n_star_events", F.lit(0))).alias("star_events"), pick("status"), F.coalesce("_new", F.lit(0)).alias("_new"))
    owner = merged.groupBy("full_name").agg(F.max(F.struct("_new", "repo_id")).alias("_own"), F.count("*").alias("_many")).where("_many > 1")
    out = merged.join(owner, "full_name", "left")
    stale = F.col("_own").isNotNull() & (F.col("_own.repo_id") != F.col("repo_id"))
    return out.withColumn("full_name", F.when(stale, F.concat("full_name", F.lit("#stale:"), F.col("repo_id").cast("string"))).otherwise(F.col("full_name"))).drop("_own", "_many", "_new")


def reset_source(table: DataFrame, source: str) -> DataFrame:
    """A table without the rows of one source."""
    return table.where(~F.col("source").eqNullSafe(F.lit(source)))


class VersionedTable:
    """Parquet versions under one folder; a pointer file names the current one, so readers see all of a version or none."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        at = self._fs_path(f"{self.path}/_CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["version"]
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        version = self.current()
        return self.spark.read.parquet(f"{self.path}/{version}") if version else None

    def commit(self, df: DataFrame) -> str:
        """Write a new version and point to it; the old one stays for readers that began with it."""
        number = int((self.current() or "v0-").split("-")[0][1:]) + 1
        version = f"v{number}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{version}")
        turn = self._fs_path(f"{self.path}/_NEXT-{version}")
        out = self._fs.create(turn, True)
        out.write(bytearray(json.dumps({"version": version}).encode()))
        out.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        kinds = getattr(fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(kinds, 1)
        over[0] = kinds.OVERWRITE
        at = self._fs_path(f"{self.path}/_CURRENT")
        fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(turn, at, over)  # one step, so there is always a pointer
        return version
