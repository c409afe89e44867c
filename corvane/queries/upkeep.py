"""Units of work, leases, listings and judges over whole tables, each with SQL. Limits are those of a task that takes work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import dedup, evaluate, ledger, planning
from corvane.operators import operations as ops
from corvane.session import read
from corvane.sources import catalog

NOW = "2024-01-15 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Documents as units: unit_key, ord, processed_at, stage."""
    docs = read(spark, d, "documents")
    return docs.select(F.lit("docs").alias("store"), F.col("doc_id").alias("unit_key"), (F.col("n_chars") % 97).alias("ord"), F.col("published_at").alias("processed_at"), F.split_part("source", F.lit("_"), F.lit(1)).alias("stage"), F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("claimed_at"))


def pending_stage_in(spark: SparkSession, d: str) -> DataFrame:
    return planning.pending_units(_units(spark, d), planning.pending_predicate("stage_in", stages=("wiki", "hn")), limit=1000).select("unit_key")


def pending_rotate(spark: SparkSession, d: str) -> DataFrame:
    """The hundred units that were processed longest ago (the limit of a task)."""
    return planning.pending_units(_units(spark, d), planning.pending_predicate("rotate"), order="processed_at", limit=100).select("unit_key")


def pending_by_ord(spark: SparkSession, d: str) -> DataFrame:
    return planning.pending_units(_units(spark, d), planning.pending_predicate("rotate"), order="ord", limit=100).select("unit_key", "ord")


def claim_lease(spark: SparkSession, d: str) -> DataFrame:
    """Units of one stage are claimed; others stay as they were."""
    units = _units(spark, d)
    got = planning.claim(units, units.where("stage = 'news'"), _now())
    return got.groupBy("stage", "status").agg(F.count("*").alias("units"), F.count("claimed_at").alias("claimed"))


def pending_repositories(spark: SparkSession, d: str) -> DataFrame:
    repos = read(spark, d, "documents").select(F.col("doc_id").alias("repo_id"), F.split_part("source", F.lit("_"), F.lit(1)).alias("status"), (F.col("n_chars") % 50).alias("star_events"), F.col("n_chars").alias("stars"))
    return planning.pending_repositories(repos, ("github", "hf"), 10, 1000, repos.where("repo_id % 5 = 0")).select("repo_id", "stars")


def hydrated_repositories(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    rows = docs.select(
        F.col("doc_id").alias("repo_id"), F.col("source").alias("full_name"), F.when(F.col("doc_id") % 7 > 0, F.col("n_chars")).alias("stars"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("  ")).otherwise("upper").alias("readme_upper"), F.when(F.col("doc_id") % 3 == 0, "lower").alias("readme_lower"), F.lit("plain").alias("readme_plain"),
    )
    return catalog.hydrated_repositories(rows, 500)


def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty entries of every feed, in document order (the feed's own limit)."""
    entries = read(spark, d, "documents").select(F.col("source").alias("feed"), F.col("doc_id").alias("position"), F.col("url").alias("link"))
    return catalog.feed_entries(entries, 50).select("feed", "position")


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("task_id"), F.when(F.col("event_type") == "error", "running").otherwise("ready").alias("state"), F.col("ts").cast("timestamp").alias("lease_until"), (F.col("event_id") % 4).alias("attempts"), F.lit(3).alias("max_attempts"))


def expired_leases(spark: SparkSession, d: str) -> DataFrame:
    return ops.expired_leases(_tasks(spark, d), _now(), 1000).select("task_id", "next_state")


def scheduler_lag(spark: SparkSession, d: str) -> DataFrame:
    triggers = read(spark, d, "orders").select((F.col("o_orderkey") % 3 > 0).alias("enabled"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '10000' DAY")).alias("next_fire_at"))
    return ops.scheduler_lag(triggers, _now())


def source_overview(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("source", F.when(F.col("doc_id") % 3 == 0, "searchable").otherwise("staged").alias("status"), F.col("created_at").alias("indexed_at"))
    runs = read(spark, d, "ledger_snapshots").select("source", F.when(F.col("status") == "staged", "running").otherwise("succeeded").alias("state"), F.col("delivered_at").alias("started_at"))
    return ops.source_overview(read(spark, d, "sources"), docs, runs).select("source", "documents", "searchable", "active_runs", F.col("last_indexed").isNotNull().alias("indexed"), F.col("last_run").isNotNull().alias("ran"))


def overall_blend(spark: SparkSession, d: str) -> DataFrame:
    """Every event type counts once, however many events it has."""
    scores = read(spark, d, "events").select("event_type", *[(F.col("event_id") % n / n).alias(c) for c, n in (("ndcg", 7), ("mrr", 5), ("recall", 3), ("precision", 11), ("hit", 2))])
    return evaluate.overall(evaluate.means(scores, ("event_type",)))


def judge_grades(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(evaluate.judge_grade(F.concat(F.lit("grade: "), F.substring("text_hash", 1, 3))).alias("grade")).groupBy("grade").agg(F.count("*").alias("answers"))


def prune_bands(spark: SparkSession, d: str) -> DataFrame:
    store = read(spark, d, "events").select(F.col("event_id").alias("id"), F.to_date("ts").alias("day"))
    return dedup.prune_bands(store, "day", 10, F.lit("2024-01-15").cast("date")).select("id")


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    units = read(spark, d, "documents").select(
        F.lit("docs").alias("store"), F.col("doc_id").alias("unit_key"), F.col("text_hash").alias("upstream"), F.when(F.col("doc_id") % 2 == 0, F.split_part("source", F.lit("_"), F.lit(1))).alias("stage"),
        F.create_map(F.lit("source"), F.col("source")).alias("attrs"), F.lit("done").alias("status"), F.lit(1).alias("ordinal"),
    )
    incoming = units.where("unit_key % 3 > 0").withColumn("upstream", F.lit("moved")).withColumn("attrs", F.create_map(F.lit("new"), F.lit("yes")))
    return units.where("unit_key % 4 > 0").drop("ordinal"), incoming


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    got = ledger.upsert_units(*_states(spark, d), "merge")
    return got.select("unit_key", "upstream", "stage", "status", F.element_at("attrs", "source").alias("source"), F.element_at("attrs", "new").alias("new"))


def upsert_skip(spark: SparkSession, d: str) -> DataFrame:
    return ledger.upsert_units(*_states(spark, d), "skip").select("unit_key", "upstream", "status")


QUERIES = {f.__name__: f for f in (
    pending_stage_in, pending_rotate, pending_by_ord, claim_lease, pending_repositories, hydrated_repositories, feed_entries, expired_leases, scheduler_lag,
    source_overview, overall_blend, judge_grades, prune_bands, upsert_merge, upsert_skip,
)}

_STAGE = "split_part(source, '_', 1)"
SQL = {
    "pending_stage_in": f"SELECT doc_id AS unit_key FROM documents WHERE {_STAGE} IN ('wiki', 'hn') ORDER BY doc_id LIMIT 1000",
    "pending_rotate": "SELECT doc_id AS unit_key FROM documents ORDER BY published_at ASC NULLS FIRST, doc_id LIMIT 100",
    "pending_by_ord": "SELECT doc_id AS unit_key, n_chars % 97 AS ord FROM documents ORDER BY ord ASC NULLS LAST, doc_id LIMIT 100",
    "claim_lease": f"SELECT {_STAGE} AS stage, CASE WHEN {_STAGE} = 'news' THEN 'processing' ELSE 'pending' END AS status, count(*) AS units, count(*) FILTER ({_STAGE} = 'news') AS claimed FROM documents GROUP BY 1, 2",
    "pending_repositories": f"SELECT doc_id AS repo_id, n_chars AS stars FROM documents WHERE {_STAGE} IN ('github', 'hf') AND n_chars % 50 >= 10 AND doc_id % 5 <> 0 ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 1000",
    "hydrated_repositories": """
        SELECT doc_id AS repo_id, source AS full_name, CASE WHEN doc_id % 7 > 0 THEN n_chars END AS stars, CASE WHEN doc_id % 2 = 1 THEN 'upper' WHEN doc_id % 3 = 0 THEN 'lower' ELSE 'plain' END AS readme,
        CASE WHEN doc_id % 7 = 0 OR n_chars IS NULL THEN 'gone' WHEN n_chars < 500 THEN 'below_threshold' ELSE 'hydrated' END AS stage FROM documents""",
    "feed_entries": "SELECT source AS feed, doc_id AS position FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 50",
    "expired_leases": f"SELECT event_id AS task_id, CASE WHEN event_id % 4 >= 3 THEN 'failed' ELSE 'ready' END AS next_state FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '{NOW}' ORDER BY ts, event_id LIMIT 1000",
    "scheduler_lag": f"""
        WITH t AS (SELECT o_orderdate + INTERVAL 10000 DAY AS fires FROM orders WHERE o_orderkey % 3 > 0 AND o_orderdate + INTERVAL 10000 DAY <= TIMESTAMP '{NOW}')
        SELECT count(*) AS due, coalesce(CAST(max(epoch(TIMESTAMP '{NOW}') - epoch(fires)) AS BIGINT), 0) AS lag_s FROM t""",
    "source_overview": """
        WITH d AS (SELECT source, count(*) AS documents, count(*) FILTER (doc_id % 3 = 0) AS searchable, max(created_at) AS last FROM documents GROUP BY 1),
        r AS (SELECT source, count(*) FILTER (status = 'staged') AS active_runs, max(delivered_at) AS last_run FROM ledger_snapshots GROUP BY 1)
        SELECT source, coalesce(documents, 0) AS documents, coalesce(searchable, 0) AS searchable, coalesce(active_runs, 0) AS active_runs, last IS NOT NULL AS indexed, last_run IS NOT NULL AS ran
        FROM sources LEFT JOIN d USING (source) LEFT JOIN r USING (source)""",
    "overall_blend": """
        WITH m AS (SELECT event_type, round(avg(event_id % 7 / 7), 6) AS ndcg, round(avg(event_id % 5 / 5), 6) AS mrr, round(avg(event_id % 3 / 3), 6) AS recall, round(avg(event_id % 11 / 11), 6) AS precision, round(avg(event_id % 2 / 2), 6) AS hit FROM events GROUP BY 1)
        SELECT round(avg(ndcg), 4) AS ndcg, round(avg(mrr), 4) AS mrr, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(hit), 4) AS hit FROM m""",
    "judge_grades": "SELECT CASE WHEN regexp_extract(substr(text_hash, 1, 3), '[0-9]') <> '' THEN least(CAST(regexp_extract(substr(text_hash, 1, 3), '[0-9]') AS INTEGER), 3) END AS grade, count(*) AS answers FROM documents GROUP BY 1",
    "prune_bands": "SELECT event_id AS id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05'",
    "upsert_merge": f"""
        SELECT doc_id AS unit_key, CASE WHEN doc_id % 3 > 0 THEN 'moved' ELSE text_hash END AS upstream, CASE WHEN doc_id % 2 = 0 THEN {_STAGE} END AS stage, CASE WHEN doc_id % 3 > 0 THEN 'pending' ELSE 'done' END AS status,
        CASE WHEN doc_id % 4 > 0 THEN source END AS source, CASE WHEN doc_id % 3 > 0 THEN 'yes' END AS new FROM documents WHERE doc_id % 3 > 0 OR doc_id % 4 > 0""",
    "upsert_skip": """
        SELECT doc_id AS unit_key, CASE WHEN doc_id % 4 = 0 THEN 'moved' ELSE text_hash END AS upstream, CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'done' END AS status
        FROM documents WHERE doc_id % 3 > 0 OR doc_id % 4 > 0""",
}
