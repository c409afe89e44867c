"""Dedup, filters, ledger, push and planning over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import dedup, filters, ledger, planning
from corvane.queries.text import HASH
from corvane.session import WHITE, read
from corvane.sources import push

NOW = "2023-06-01 00:00:00"


def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", text.document_hash(F.lit(""), F.col("text")).alias("digest"))
    return dedup.exact_duplicates(docs, "digest", "doc_id", "doc_id").where("duplicate_of IS NOT NULL").select("doc_id", "duplicate_of")


def dedup_exact_vs_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Batches 1 to 6 against a ledger of batch 0; every seventh of its records is deleted."""
    rows = read(spark, d, "ingest_docs").where("text IS NOT NULL").select("ingest_id", "batch_no", "arrived_at", text.text_hash(F.col("text")).alias("digest"))
    owners = rows.where("batch_no = 0").select(F.col("ingest_id").alias("id"), "digest", F.when(F.col("ingest_id") % 7 == 0, "deleted").otherwise("searchable").alias("status"), F.col("arrived_at").alias("created_at"))
    return dedup.exact_duplicates(rows.where("batch_no > 0"), "digest", "ingest_id", "ingest_id", owners).where("duplicate_of IS NOT NULL").select("ingest_id", "duplicate_of")


def dedup_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.text_hash(F.col("text")).alias("digest"))
    return dedup.keep_first(docs, F.col("digest"), "doc_id", 1).select("doc_id")


def minhash_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The reference's greedy rule over its own sketch: 112 permutations, 14 bands, first kept document wins."""
    docs = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return dedup.greedy_duplicates(dedup.band_pairs(dedup.signature_bands(docs, "doc_id", "text"), "doc_id", "doc_id")).select(F.col("id").alias("doc_id"), "duplicate_of")


def filter_lang(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(filters.language_allowed(F.col("lang"), ("en", "de"))).select("doc_id")


def filter_length(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(filters.long_enough(F.col("text"))).select("doc_id")


def quality_reasons(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", filters.quality_reason(F.col("text")).alias("reason"))


def repetition_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.repetition(read(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return rows.select("doc_id", F.round("duplicate_lines", 6).alias("duplicate_lines"), F.round("top_2", 6).alias("top_2"))


def c4_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.length(filters.c4_lines(F.col("text"))).cast("bigint").alias("chars"), filters.c4_reason(F.col("text")).alias("reason"))


def fineweb_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", filters.fineweb_reason(F.col("text")).alias("reason"))


# --- ledger: the snapshot before is the ledger, the next one comes in ---------------------------------------------------
def _snapshot(spark: SparkSession, d: str, number: int) -> DataFrame:
    rows = read(spark, d, "ledger_snapshots").where(f"snapshot_no = {number}").groupBy("id").agg(F.max(F.struct("revision_ts", "text_hash", "title", "url", "source", "status")).alias("r"))
    return rows.select("id", "r.source", "r.url", "r.title", "r.text_hash", "r.status", "r.revision_ts")


def _prior(spark: SparkSession, d: str) -> DataFrame:
    rows = _snapshot(spark, d, 1)
    status = F.when(F.length("id") % 2 == 0, "searchable").otherwise("staged")
    return rows.select(
        "id", "source", "url", "title", "text_hash", F.md5(F.coalesce("title", F.lit(""))).alias("metadata_hash"), status.alias("status"), F.lit("2020-01-01").cast("timestamp").alias("created_at"),
        F.lit("2020-01-02").cast("timestamp").alias("updated_at"), F.lit("m1").alias("embedded_model"), F.lit("2020-01-03").cast("timestamp").alias("indexed_at"),
    )


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    rows = _snapshot(spark, d, 2)
    status = F.when(F.col("text_hash").isNull(), "empty").when(F.ascii(F.right("id", F.lit(1))) % 7 == 0, "deleted").otherwise("staged")
    return rows.select("id", "source", "url", "title", "text_hash", F.md5(F.coalesce("title", F.lit(""))).alias("metadata_hash"), status.alias("status"))


def stage_actions(spark: SparkSession, d: str) -> DataFrame:
    return ledger.stage_actions(_incoming(spark, d), _prior(spark, d)).select("id", "action")


def ledger_merge(spark: SparkSession, d: str) -> DataFrame:
    out = ledger.merge_ledger(_prior(spark, d), _incoming(spark, d), F.lit(NOW).cast("timestamp"))
    return out.select("id", "title", "text_hash", "status", F.year("updated_at").cast("bigint").alias("updated"), "changed")


def index_queues(spark: SparkSession, d: str) -> DataFrame:
    out = ledger.merge_ledger(_prior(spark, d), _incoming(spark, d), F.lit(NOW).cast("timestamp"))
    old = _prior(spark, d).select("id", F.col("metadata_hash").alias("indexed_metadata_hash"))
    return ledger.index_queues(out.join(old, "id", "left"))


def tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Two sources are covered, one of them with a census that was cut off."""
    present = _snapshot(spark, d, 2).where("source IN ('news_tidewater', 'wiki_lumen')").select("id", "source", (F.col("source") == "wiki_lumen").alias("truncated"))
    return ledger.tombstone_missing(_prior(spark, d), present).where("tombstoned").select("id")


def coverage_guard(spark: SparkSession, d: str) -> DataFrame:
    present = _snapshot(spark, d, 2).select("id", "source", (F.col("source") == "wiki_lumen").alias("truncated"))
    return ledger.coverage_guard(present)


def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Units are users; two assertions of every user come in, the second without a stage."""
    ev = read(spark, d, "events")
    prior = ev.where("user_id % 3 > 0").groupBy(F.lit("u").alias("store"), F.col("user_id").cast("string").alias("unit_key")).agg(F.lit("t0").alias("upstream"), F.lit("old").alias("stage"), F.create_map(F.lit("a"), F.lit("1"), F.lit("n"), F.lit("5")).alias("attrs"), F.lit("done").alias("status"))
    new = ev.groupBy(F.lit("u").alias("store"), F.col("user_id").cast("string").alias("unit_key")).agg(F.count("*").cast("double").alias("c"))
    new = new.where("c > 60").select("store", "unit_key", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"), "c")
    new = new.select(
        "store", "unit_key", "ordinal", F.lit("t1").alias("upstream"), F.when(F.col("ordinal") == 1, "fresh").alias("stage"), F.create_map(F.lit("b"), F.col("ordinal").cast("string")).alias("attrs"),
        F.create_map(F.lit("n"), F.col("c")).alias("delta"),
    )
    out = ledger.upsert_units(prior, new, "increment")
    return out.select("unit_key", "upstream", "stage", "status", F.col("attrs")["a"].alias("a"), F.col("attrs")["b"].alias("b"), F.col("attrs")["n"].cast("double").alias("n"))


def repositories_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("source = 'github_readmes'")
    shape = lambda name, stars, events: docs.select(F.col("doc_id").alias("repo_id"), name.alias("full_name"), F.col("title").alias("description"), stars.alias("stars"), F.array().cast("array<string>").alias("topics"), events.alias("star_events"), F.lit("seen").alias("status"))
    prior = shape(F.col("id"), F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))
    new = shape(F.concat(F.lit("n"), (F.col("doc_id") % 50).cast("string")), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")), F.lit(3).cast("bigint")).where("doc_id % 3 = 0")
    return ledger.merge_repositories(prior, new).select("repo_id", "full_name", "stars", "star_events")


def reset_source(spark: SparkSession, d: str) -> DataFrame:
    return ledger.reset_source(_prior(spark, d).select("id", "source"), "news_tidewater").groupBy("source").agg(F.count("*").alias("rows"))


# --- planning --------------------------------------------------------------------------------------------------------
def _units(spark: SparkSession, d: str) -> DataFrame:
    """Event types and users as stores and keys: what came is upstream, what came before the middle of January is ingested."""
    ev = read(spark, d, "events")
    return ev.groupBy(F.col("event_type").alias("store"), F.col("user_id").cast("string").alias("unit_key")).agg(
        F.max("event_id").cast("string").alias("upstream"), F.max(F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), F.col("event_id"))).cast("string").alias("ingested"),
        F.max(F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), F.col("ts"))).alias("processed_at"), F.sum("value").alias("stars"), F.min("event_id").alias("ord"),
    )


def watermark_unseen(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).where(planning.pending_predicate("unseen")).select("store", "unit_key")


def watermark_moved(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).where(planning.pending_predicate("token_moved")).select("store", "unit_key")


def watermark_rearm(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).where(planning.pending_predicate("rearm", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), days=7)).select("store", "unit_key")


def watermark_advance(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d).withColumn("status", F.lit("pending"))
    done = units.where("store IN ('click', 'view')")
    return ledger.advance_watermarks(units, done).select("store", "unit_key", "ingested", "status").where("ingested IS NOT NULL")


def pending_by_stars(spark: SparkSession, d: str) -> DataFrame:
    """Top-k report: the 50 units with the most stars that were not emitted yet."""
    units = _units(spark, d)
    emitted = units.where("store = 'view'")
    return planning.pending_units(units, planning.pending_predicate("token_moved"), "stars_desc", 50, emitted).select("store", "unit_key")


def calendar_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of a trailing window without any event."""
    keys = planning.calendar_keys(spark, "2024-02-05", 40)
    have = read(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("unit_key")).distinct()
    return keys.join(have, "unit_key", "left_anti").select("unit_key")


def backfill_months(spark: SparkSession, d: str) -> DataFrame:
    windows = planning.backfill_windows(spark, "2020-01-15", "2025-06-30", "month")
    days = read(spark, d, "documents").where("created_at IS NOT NULL").select(F.to_date("created_at").alias("day")).groupBy("day").agg(F.count("*").alias("n"))
    return windows.join(F.broadcast(days), F.col("day").between(F.col("starts"), F.col("ends")), "left").groupBy("unit_key").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))


def daily_shards(spark: SparkSession, d: str) -> DataFrame:
    have = read(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("x")).distinct().select(F.concat("x", F.lit(".."), "x", F.lit("@10")).alias("unit_key"))
    return planning.daily_shards(spark, "2023-12-01", "2024-02-15", 10, have)


def crawl_levels(spark: SparkSession, d: str) -> DataFrame:
    """Breadth first over orders: a customer leads to the customer whose number is a third of an order's."""
    orders = read(spark, d, "orders")
    links = orders.select(F.col("o_custkey").cast("string").alias("src"), F.floor(F.col("o_orderkey") / 3).cast("string").alias("dst")).distinct()
    seeds = orders.select(F.col("o_custkey").cast("string").alias("url")).where("o_custkey <= 5").distinct()
    return planning.crawl(seeds, links, 2, 10**9).select("url", F.col("depth").cast("bigint").alias("depth"))


# --- push ------------------------------------------------------------------------------------------------------------
def _pushed(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "ingest_docs")
    pid = F.concat(F.lit("c"), (F.col("ingest_id") % 40).cast("string"))
    fields = F.to_json(F.struct(F.when(F.col("ingest_id") % 2 == 0, pid).alias("conversation_id"), F.array((F.col("ingest_id") % 5).cast("int"), F.lit(2)).alias("message_range")))
    return docs.select(F.concat(F.when(F.col("ingest_id") % 9 == 0, F.lit("other")).otherwise(pid), F.lit("/"), F.lpad(F.col("ingest_id").cast("string"), 7, "0")).alias("id"), "text", fields.alias("fields"), "ingest_id")


def push_checks(spark: SparkSession, d: str) -> DataFrame:
    return push.checked(_pushed(spark, d), 5000).select("ingest_id", "partition", "reason")


def push_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = _pushed(spark, d)
    return rows.select("ingest_id", push.memory_suffix(push.conversation_of(F.col("id"), F.col("fields")), (F.col("ingest_id") % 1000).cast("int")).alias("suffix"))


def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source")
    merged = push.merged_metadata(F.create_map(F.lit("source"), F.lit("x"), F.lit("_secret"), F.lit("y"), F.lit("extra"), F.col("url")), F.create_map(F.lit("source"), s))
    return read(spark, d, "ingest_docs").select("ingest_id", merged["source"].alias("source"), merged["extra"].alias("extra"), F.size(merged).cast("bigint").alias("n"))


QUERIES = {f.__name__: f for f in (
    dedup_exact, dedup_exact_vs_ledger, dedup_boilerplate, minhash_duplicates, filter_lang, filter_length, quality_reasons, repetition_shares, c4_filter, fineweb_filter,
    stage_actions, ledger_merge, index_queues, tombstones, coverage_guard, store_upsert, repositories_merge, reset_source,
    watermark_unseen, watermark_moved, watermark_rearm, watermark_advance, pending_by_stars, calendar_days, backfill_months, daily_shards, crawl_levels,
    push_checks, push_identity, metadata_merge,
)}

DIGEST = f"sha1(trim(regexp_replace(lower(chr(10) || chr(10) || coalesce(text, '')), '{WHITE}', ' ', 'g')))"
SNAP = lambda n: f"SELECT id, source, url, title, text_hash, status FROM ledger_snapshots WHERE snapshot_no = {n} QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision_ts DESC NULLS LAST, text_hash DESC NULLS LAST, title DESC NULLS LAST, url DESC NULLS LAST) = 1"
LEDGER = f"""
    prior AS (SELECT id, source, url, title, text_hash, md5(coalesce(title, '')) AS meta, CASE WHEN length(id) % 2 = 0 THEN 'searchable' ELSE 'staged' END AS status FROM ({SNAP(1)})),
    incoming AS (SELECT id, source, url, title, text_hash, md5(coalesce(title, '')) AS meta, CASE WHEN text_hash IS NULL THEN 'empty' WHEN ascii(right(id, 1)) % 7 = 0 THEN 'deleted' ELSE 'staged' END AS status FROM ({SNAP(2)}))"""
MERGED = LEDGER + """,
    both_ AS (SELECT coalesce(p.id, i.id) AS id, p.id IS NOT NULL AS had, i.id IS NOT NULL AS has, p.title AS pt, i.title AS it, p.text_hash AS ph, i.text_hash AS ih, p.url AS pu, i.url AS iu, p.meta AS pm, i.meta AS im, p.status AS ps,
      CASE WHEN i.status = 'staged' AND p.status = 'searchable' AND p.text_hash IS NOT DISTINCT FROM i.text_hash THEN 'searchable' ELSE i.status END AS ns FROM prior p FULL JOIN incoming i ON p.id = i.id),
    merged AS (SELECT *, has AND (NOT had OR pt IS DISTINCT FROM it OR ph IS DISTINCT FROM ih OR pu IS DISTINCT FROM iu OR pm IS DISTINCT FROM im OR ps IS DISTINCT FROM ns) AS changed FROM both_)"""
UNITS = """units AS (SELECT event_type AS store, CAST(user_id AS VARCHAR) AS unit_key, CAST(max(event_id) AS VARCHAR) AS upstream, CAST(max(event_id) FILTER (ts < TIMESTAMP '2024-01-15') AS VARCHAR) AS ingested,
      max(ts) FILTER (ts < TIMESTAMP '2024-01-15') AS processed_at, sum(value) AS stars FROM events GROUP BY 1, 2)"""
PUSHED = """p AS (SELECT *, 'c' || (ingest_id % 40) AS pid FROM ingest_docs), q AS (SELECT *, (CASE WHEN ingest_id % 9 = 0 THEN 'other' ELSE pid END) || '/' || lpad(CAST(ingest_id AS VARCHAR), 7, '0') AS id FROM p),
      r AS (SELECT *, CASE WHEN ingest_id % 2 = 0 THEN pid ELSE split_part(id, '/', 1) END AS part FROM q)"""
LINES = r"list_filter(string_split_regex(text, '\r?\n'), lambda x: trim(x) <> '')"
TOKENS = r"list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

SQL = {
    "dedup_exact": f"WITH h AS (SELECT doc_id, {DIGEST} AS h FROM documents), f AS (SELECT h, min(doc_id) AS m FROM h GROUP BY 1) SELECT doc_id, m AS duplicate_of FROM h JOIN f USING (h) WHERE m <> doc_id",
    "dedup_exact_vs_ledger": f"""
        WITH h AS (SELECT ingest_id, batch_no, arrived_at, {HASH} AS h FROM ingest_docs WHERE text IS NOT NULL),
        l AS (SELECT h, ingest_id AS owner FROM h WHERE batch_no = 0 AND ingest_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY h ORDER BY arrived_at, ingest_id) = 1),
        f AS (SELECT h, min(ingest_id) AS m FROM h WHERE batch_no > 0 GROUP BY 1)
        SELECT ingest_id, coalesce(owner, m) AS duplicate_of FROM h LEFT JOIN l USING (h) JOIN f USING (h) WHERE batch_no > 0 AND coalesce(owner, m) <> ingest_id""",
    "dedup_boilerplate": f"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY {HASH}",
    "filter_lang": "SELECT doc_id FROM documents WHERE CASE WHEN coalesce(trim(lang), '') = '' THEN 'en' ELSE split_part(lower(trim(lang)), '-', 1) END IN ('en', 'de')",
    "filter_length": "SELECT doc_id FROM documents WHERE length(trim(text)) >= 200",
    "quality_reasons": rf"""
        WITH t AS (SELECT doc_id, text, {TOKENS} AS t, {LINES} AS l FROM documents WHERE text IS NOT NULL), n AS (SELECT *, len(t) AS n, greatest(len(l), 1) AS m FROM t)
        SELECT doc_id, CASE WHEN n < 50 THEN 'few words' WHEN n > 100000 THEN 'many words' WHEN length(array_to_string(t, '')) / greatest(n, 1) NOT BETWEEN 3 AND 10 THEN 'word length'
          WHEN (len(string_split(text, '#')) - 1 + len(string_split_regex(text, '\.\.\.|…')) - 1) / greatest(n, 1) > 0.1 THEN 'symbols'
          WHEN len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[-•*]'))) / m > 0.9 THEN 'bullets' WHEN len(list_filter(l, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) / m > 0.3 THEN 'ellipses'
          WHEN len(list_filter(t, lambda x: regexp_matches(x, '\p{{L}}'))) / greatest(n, 1) < 0.8 THEN 'not words'
          WHEN len(list_filter([{", ".join(f"'{w}'" for w in filters.STOP_WORDS)}], lambda w: list_contains(list_transform(t, lambda x: lower(x)), w))) < 2 THEN 'stop words' ELSE '' END AS reason FROM n""",
    "c4_filter": rf"""
        SELECT doc_id, CAST(length(coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: len(list_filter(string_split_regex(x, '[ \t\n\x0B\f\r]+'), lambda y: y <> '')) >= 3 AND NOT contains(lower(x), 'javascript')), chr(10)), '')) AS BIGINT) AS chars,
          CASE WHEN contains(lower(text), 'lorem ipsum') THEN 'filler' WHEN contains(text, '{{') THEN 'braces' WHEN len(string_split_regex(text, '[.!?]([ \t\n\x0B\f\r]|$)')) - 1 < 5 THEN 'few sentences' ELSE '' END AS reason
        FROM documents WHERE text IS NOT NULL""",
    "fineweb_filter": rf"""
        WITH t AS (SELECT doc_id, {LINES} AS l FROM documents WHERE text IS NOT NULL), n AS (SELECT *, greatest(len(l), 1) AS m FROM t)
        SELECT doc_id, CASE WHEN len(list_filter(l, lambda x: regexp_matches(rtrim(x), '[.?!"''”]$'))) / m <= 0.12 THEN 'line ends'
          WHEN 1 - length(coalesce(array_to_string(list_distinct(l), ''), '')) / greatest(length(coalesce(array_to_string(l, ''), '')), 1) >= 0.1 THEN 'repeated lines'
          WHEN len(list_filter(l, lambda x: length(x) <= 30)) / m >= 0.67 THEN 'short lines' ELSE '' END AS reason FROM n""",
    "stage_actions": f"""
        WITH {LEDGER}, r AS (SELECT i.id, i.status, p.status AS ps, i.text_hash IS DISTINCT FROM p.text_hash OR i.meta IS DISTINCT FROM p.meta AS changed FROM incoming i LEFT JOIN prior p USING (id))
        SELECT id, CASE WHEN status = 'deleted' THEN 'ledger' WHEN status IN ('duplicate', 'empty') THEN CASE WHEN changed OR coalesce(ps, '') NOT IN ('duplicate', 'empty') THEN 'ledger' ELSE 'skip' END
          WHEN changed OR ps IS DISTINCT FROM 'searchable' THEN 'write' ELSE 'skip' END AS action FROM r""",
    "ledger_merge": f"WITH {MERGED} SELECT id, CASE WHEN changed THEN it ELSE pt END AS title, CASE WHEN changed THEN ih ELSE ph END AS text_hash, CASE WHEN changed THEN ns ELSE ps END AS status, CAST(CASE WHEN changed OR NOT had THEN 2023 ELSE 2020 END AS BIGINT) AS updated, changed FROM merged",
    "index_queues": f"""
        WITH {MERGED}, m AS (SELECT id, had, pm, CASE WHEN changed THEN im ELSE pm END AS meta, CASE WHEN changed THEN ns ELSE ps END AS status FROM merged),
        q AS (SELECT id, CASE WHEN status IN ('deleted', 'duplicate', 'empty') AND had THEN 'delete' WHEN status = 'searchable' AND meta IS DISTINCT FROM pm THEN 'refresh' WHEN status = 'staged' THEN 'embed' END AS queue FROM m)
        SELECT id, queue FROM q WHERE queue IS NOT NULL""",
    "tombstones": f"WITH {LEDGER} SELECT id FROM prior WHERE source = 'news_tidewater' AND status <> 'deleted' AND id NOT IN (SELECT id FROM ({SNAP(2)}) WHERE source = 'news_tidewater')",
    "coverage_guard": f"SELECT source, count(DISTINCT id) AS documents, source = 'wiki_lumen' AS truncated, CASE WHEN source = 'wiki_lumen' THEN 'truncated' ELSE 'ok' END AS verdict FROM ({SNAP(2)}) GROUP BY source",
    "store_upsert": """
        WITH c AS (SELECT CAST(user_id AS VARCHAR) AS unit_key, user_id % 3 > 0 AS had, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT *, c > 60 AS has FROM c)
        SELECT unit_key, CASE WHEN has THEN 't1' ELSE 't0' END AS upstream, CASE WHEN has THEN 'fresh' ELSE 'old' END AS stage, CASE WHEN has THEN 'pending' ELSE 'done' END AS status, CASE WHEN had THEN '1' END AS a,
          CASE WHEN has THEN '2' END AS b, CAST((CASE WHEN had THEN 5 ELSE 0 END) + (CASE WHEN has THEN 2 * c ELSE 0 END) AS DOUBLE) AS n FROM r WHERE had OR has""",
    "repositories_merge": """
        WITH g AS (SELECT doc_id, id, n_chars FROM documents WHERE source = 'github_readmes'), m AS (SELECT doc_id AS repo_id, doc_id % 3 = 0 AS new, CASE WHEN doc_id % 3 = 0 THEN 'n' || (doc_id % 50) ELSE id END AS name,
          CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN coalesce(n_chars, 1) ELSE 1 END AS stars, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 2 END AS star_events FROM g)
        SELECT repo_id, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY new DESC, repo_id DESC) > 1 THEN name || '#stale:' || repo_id ELSE name END AS full_name, CAST(stars AS BIGINT) AS stars, CAST(star_events AS BIGINT) AS star_events FROM m""",
    "reset_source": f"SELECT source, count(*) AS rows FROM ({SNAP(1)}) WHERE source IS DISTINCT FROM 'news_tidewater' GROUP BY 1",
    "watermark_unseen": f"WITH {UNITS} SELECT store, unit_key FROM units WHERE ingested IS NULL",
    "watermark_moved": f"WITH {UNITS} SELECT store, unit_key FROM units WHERE upstream IS DISTINCT FROM ingested",
    "watermark_rearm": f"WITH {UNITS} SELECT store, unit_key FROM units WHERE ingested IS NULL OR processed_at IS NULL OR processed_at < TIMESTAMP '2024-01-13'",
    "watermark_advance": f"WITH {UNITS} SELECT store, unit_key, CASE WHEN store IN ('click', 'view') THEN upstream ELSE ingested END AS ingested, CASE WHEN store IN ('click', 'view') THEN 'done' ELSE 'pending' END AS status FROM units WHERE store IN ('click', 'view') OR ingested IS NOT NULL",
    "pending_by_stars": f"WITH {UNITS} SELECT store, unit_key FROM units WHERE upstream IS DISTINCT FROM ingested AND store <> 'view' ORDER BY stars DESC, unit_key LIMIT 50",
    "calendar_days": "SELECT strftime(x, '%Y-%m-%d') AS unit_key FROM unnest(range(TIMESTAMP '2024-02-05' - INTERVAL 40 DAY, TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS t(x) WHERE strftime(x, '%Y-%m-%d') NOT IN (SELECT strftime(ts, '%Y-%m-%d') FROM events)",
    "backfill_months": """
        WITH m AS (SELECT greatest(CAST(x AS DATE), DATE '2020-01-15') AS s, least(last_day(CAST(x AS DATE)), DATE '2025-06-30') AS e FROM unnest(range(TIMESTAMP '2020-01-01', TIMESTAMP '2025-07-01', INTERVAL 1 MONTH)) AS t(x))
        SELECT CAST(s AS VARCHAR) || '..' || CAST(e AS VARCHAR) AS unit_key, (SELECT count(*) FROM documents WHERE CAST(created_at AT TIME ZONE 'UTC' AS DATE) BETWEEN s AND e) AS documents FROM m""",
    "daily_shards": """
        SELECT strftime(x, '%Y-%m-%d') || '..' || strftime(x, '%Y-%m-%d') || '@10' AS unit_key FROM unnest(range(TIMESTAMP '2023-12-01', TIMESTAMP '2024-02-16', INTERVAL 1 DAY)) AS t(x)
        WHERE strftime(x, '%Y-%m-%d') NOT IN (SELECT strftime(ts, '%Y-%m-%d') FROM events)""",
    "crawl_levels": """
        WITH RECURSIVE l AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS src, CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS VARCHAR) AS dst FROM orders),
        c AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS url, CAST(0 AS BIGINT) AS depth FROM orders WHERE o_custkey <= 5 UNION SELECT l.dst, c.depth + 1 FROM c JOIN l ON c.url = l.src WHERE c.depth < 2)
        SELECT url, min(depth) AS depth FROM c GROUP BY 1""",
    "push_checks": f"""
        WITH {PUSHED} SELECT ingest_id, part AS partition, CASE WHEN coalesce(trim(text), '') = '' THEN 'text' WHEN length(text) > 5000 THEN 'length' WHEN ingest_id % 5 > 2 THEN 'range' WHEN NOT starts_with(id, part || '/') THEN 'partition' ELSE '' END AS reason FROM r""",
    "push_identity": f"WITH {PUSHED} SELECT ingest_id, part || '/' || lpad(CAST(ingest_id % 1000 AS VARCHAR), 5, '0') AS suffix FROM r",
    "metadata_merge": "SELECT ingest_id, source, url AS extra, CAST(2 AS BIGINT) AS n FROM ingest_docs",
}
