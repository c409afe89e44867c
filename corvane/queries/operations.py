"""Operational aggregates, parsers, streams and plain relational work over whole tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import operations as ops
from corvane.plans import flows, spec
from corvane.session import Scratch, read, remove
from corvane.sources import catalog, extract
from corvane.streaming import streams


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = ops.latency(read(spark, d, "events"), "ts", "value", F.col("event_type") == "error", _at("2024-01-10"), _at("2024-01-20"))
    return out.select("searches", "degraded", "degraded_pct", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def retention(spark: SparkSession, d: str) -> DataFrame:
    return ops.retain(read(spark, d, "events"), "ts", _at("2024-01-30"), 7).select("event_id")


def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return ops.state_counts(read(spark, d, "ledger_snapshots"), "source", "status")


def recent_rates(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events")
    return ops.recent_rates(ev, ev, "user_id", "ts", _at("2024-01-15 12:00:00"), F.col("event_type") != "error")


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as tasks of a run (the order); each but the first needs the one before."""
    state = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "succeeded").when(F.col("l_linestatus") == "O", "pending").otherwise("running")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("task_id"), state.alias("state"), F.when(F.col("l_linenumber") > 1, F.array(F.col("l_linenumber") - 1)).otherwise(F.array().cast("array<int>")).alias("depends_on"),
        F.col("l_quantity").alias("weight"), F.when(F.col("l_tax") > 0.02, F.col("l_discount") * 100).alias("units_done"), F.when(F.col("l_tax") > 0.02, F.lit(10.0)).alias("units_total"),
        F.concat(F.lit("w"), (F.col("l_suppkey") % 7).cast("string")).alias("worker"), F.col("l_shipdate").alias("started_at"), F.col("l_shipdate").alias("heartbeat_at"), F.col("l_shipdate").alias("claimed_at"),
        F.element_at(F.array(F.lit("gpu"), F.lit("net"), F.lit("io")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("lane"), (F.col("l_partkey") % 5).alias("priority"), F.col("l_extendedprice").alias("virtual_time"),
    )


def worker_snapshot(spark: SparkSession, d: str) -> DataFrame:
    out = ops.worker_snapshot(_tasks(spark, d), F.lit("1999-01-01").cast("timestamp"), 300)
    return out.select("running", "ready", "workers", "claim_stalled")


def run_progress(spark: SparkSession, d: str) -> DataFrame:
    return ops.run_progress(_tasks(spark, d))


def ready_tasks(spark: SparkSession, d: str) -> DataFrame:
    return ops.ready_tasks(_tasks(spark, d))


def skipped_tasks(spark: SparkSession, d: str) -> DataFrame:
    return ops.skipped_tasks(_tasks(spark, d))


def run_states(spark: SparkSession, d: str) -> DataFrame:
    return ops.run_states(_tasks(spark, d))


def blocked_reasons(spark: SparkSession, d: str) -> DataFrame:
    tasks = _tasks(spark, d).select("run_id", "task_id", F.array(F.col("worker"), F.col("lane")).alias("preconditions"))
    return ops.blocked_reasons(tasks, ["w1", "w2", "gpu", "io"]).select("run_id", "task_id", F.array_join("missing", ",").alias("missing"), "blocked")


def fair_claim(spark: SparkSession, d: str) -> DataFrame:
    """A report of the tasks that may start: as many per lane as its cap has free."""
    tasks = _tasks(spark, d).withColumn("task_id", F.col("run_id") * 10 + F.col("task_id")).withColumn("state", F.when(F.col("state") == "pending", "ready").otherwise(F.col("state")))
    return ops.fair_claim(tasks, {"gpu": 2, "net": 5, "io": 4}, spark.createDataFrame([("net", 1)], "lane string, task_id int")).select("lane", "task_id", "place")


def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    return ops.latest(read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


def event_facets(spark: SparkSession, d: str) -> DataFrame:
    return ops.facet(read(spark, d, "documents"), "lang")


def event_page(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events").select(F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("event"), F.col("props").alias("message"), F.col("user_id").cast("string").alias("source"))
    return ops.event_page(ev, 500, 1000, "CLI").select("seq", "event")


def redacted(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"api_key": "k'), F.col("event_id").cast("string"), F.lit('", "note": "Bearer abcdefgh12345", "k": 1}'))
    return read(spark, d, "events").select("event_id", ops.redact(text).alias("text"))


def error_ratio(spark: SparkSession, d: str) -> DataFrame:
    by_day = read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("every"))
    return ops.ratio_alert(by_day, "errors", "every", 0.2).select(F.col("day").cast("string").alias("day"), "ratio", "firing")


def watch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events written as lines of an archive and counted per repository (the user); the latest name wins."""
    kind = F.when(F.col("event_type").isin("click", "view"), "WatchEvent").otherwise("PushEvent")
    line = F.to_json(F.struct(kind.alias("type"), F.struct(F.col("user_id").alias("id"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("name")).alias("repo")))
    return catalog.watch_events(read(spark, d, "events").select(F.col("event_id").alias("ordinal"), line.alias("value")))


def parquet_lookup(spark: SparkSession, d: str) -> DataFrame:
    units = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("unit_key"), "o_orderkey")
    side = read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", "event_type")
    return catalog.parquet_lookup(units, side, "key", "event_type", "event_id")


def page_manifest(spark: SparkSession, d: str) -> DataFrame:
    """URLs of pages as a list of lines: comments, repeats and other schemes go."""
    body = read(spark, d, "crawl_pages").select(F.concat(F.lit("# x\n"), F.col("url"), F.lit("\nftp://a/b\n"), F.col("url"), F.lit("\n")).alias("body"))
    return catalog.url_list(body, shrink_floor=1)


def llms_links(spark: SparkSession, d: str) -> DataFrame:
    body = read(spark, d, "documents").select(F.concat(F.lit("# t\n- [a "), F.col("doc_id").cast("string"), F.lit("](https://h.example/docs/"), F.col("doc_id").cast("string"), F.lit(".md)\nx")).alias("body"))
    return catalog.llms_txt(body)


def sitemap_entries(spark: SparkSession, d: str) -> DataFrame:
    body = read(spark, d, "documents").select(F.concat(F.lit("<urlset><url><loc> https://h.example/?a=1&amp;b="), F.col("doc_id").cast("string"), F.lit("</loc><lastmod>2024-01-02</lastmod></url></urlset>")).alias("body"))
    return catalog.sitemap(body)


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents wrapped into pages with chrome and read back: title, text length and links."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><head><title>"), esc(F.coalesce("title", F.lit(""))), F.lit("</title></head><body><nav>menu</nav><article><p>"), F.replace(esc(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit("</p><p>")), F.lit("</p><a href='/x'>x</a></article><footer>f</footer></body></html>"))
    rows = read(spark, d, "documents").select("doc_id", "url", page.alias("html"))
    got = extract.html_pages(rows, "doc_id", "url", "html")
    return got.select("doc_id", "title", F.length("text").cast("bigint").alias("chars"), F.size("links").cast("bigint").alias("links"))


def flow_news(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("text IS NOT NULL").select("url", "canonical_url", "title", "text", "lang", F.col("doc_id").alias("ordinal"), F.lit("").alias("suffix"))
    return spec.compose(flows.NEWS, flows.standard_modules({"documents": docs}), "ingest")["stage"].select("ordinal", "suffix", "duplicate_of")


def flow_crawl(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("text IS NOT NULL").select("url", "text", F.col("doc_id").alias("ordinal"))
    return spec.compose(flows.CRAWL, flows.standard_modules({"documents": docs}), "ingest")["stage"].select("ordinal")


# --- streams: the whole journal is read to its end ---------------------------------------------------------------------
def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = streams.journal_stream(spark, d, schema, glob="events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream as a written table; nothing of it passes through the driver."""
    scratch = Scratch(spark, "stream")
    checkpoint, out = scratch.path("checkpoint"), scratch.path("out")
    whole = (lambda df, _: df.write.mode("overwrite").parquet(out)) if mode == "complete" else None
    streams.run_to_end(stream, checkpoint, to=out, mode=mode, batch=whole)
    remove(spark, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    got = _run(spark, streams.windowed_counts(_stream(spark, d), "ts", ("event_type",), "1 day"))
    return got.select(F.date_format("starts", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 4).alias("total"))


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    got = _run(spark, streams.windowed_counts(_stream(spark, d), "ts", (), "2 days", "1 day"))
    return got.select(F.date_format("starts", "yyyy-MM-dd").alias("day"), "events")


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    got = _run(spark, streams.first_within(_stream(spark, d), "ts", ["user_id"], "90 days"), "append")
    return got.groupBy("user_id").agg(F.count("*").alias("rows"))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions in batch: the stream operator over a bounded table."""
    got = streams.sessions(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ("user_id",), "2 hours")
    return got.select("user_id", F.date_format("starts", "yyyy-MM-dd HH:mm:ss").alias("starts"), "events")


# --- plain relational work over the star schema -----------------------------------------------------------------------
def order_revenue(spark: SparkSession, d: str) -> DataFrame:
    line, orders, customer, nation = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return rows.groupBy("n_name", "o_orderpriority").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"), F.count("*").alias("lines"))


def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


def price_rank(spark: SparkSession, d: str) -> DataFrame:
    at = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return read(spark, d, "part").select("p_partkey", "p_brand", F.row_number().over(at).cast("bigint").alias("place"))


def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.sum("l_linenumber").alias("numbers"))


QUERIES = {f.__name__: f for f in (
    latency_percentiles, retention, state_counts, recent_rates, worker_snapshot, run_progress, ready_tasks, skipped_tasks, run_states, blocked_reasons, fair_claim, latest_rows, event_facets, event_page,
    redacted, error_ratio, watch_counts, parquet_lookup, page_manifest, llms_links, sitemap_entries, html_pages, flow_news, flow_crawl,
    stream_tumbling, stream_sliding, stream_dedup, session_windows, order_revenue, customers_without_orders, price_rank, rollup_counts,
)}

TASKS = """t AS (SELECT l_orderkey AS run_id, l_linenumber AS task_id, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'succeeded' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'running' END AS state,
      l_quantity AS weight, CASE WHEN l_tax > 0.02 THEN l_discount * 100 END AS done, CASE WHEN l_tax > 0.02 THEN 10.0 END AS total, 'w' || (l_suppkey % 7) AS worker, ['gpu', 'net', 'io'][l_suppkey % 3 + 1] AS lane, l_partkey % 5 AS priority, l_extendedprice AS vt FROM lineitem)"""
SQL = {
    "latency_percentiles": "SELECT count(*) AS searches, count(*) FILTER (event_type = 'error') AS degraded, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 1) AS degraded_pct, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'",
    "retention": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-23'",
    "state_counts": "SELECT source, status, count(*) AS rows FROM ledger_snapshots GROUP BY 1, 2",
    "recent_rates": """SELECT user_id, count(*) FILTER (event_type <> 'error' AND ts BETWEEN TIMESTAMP '2024-01-15 11:58:00' AND TIMESTAMP '2024-01-15 12:00:00') / 2.0 AS per_minute_2m,
        count(*) FILTER (event_type <> 'error' AND ts BETWEEN TIMESTAMP '2024-01-15 11:50:00' AND TIMESTAMP '2024-01-15 12:00:00') / 10.0 AS per_minute_10m FROM events GROUP BY 1""",
    "worker_snapshot": f"WITH {TASKS} SELECT count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'ready') AS ready, count(DISTINCT worker) FILTER (state = 'running') AS workers, false AS claim_stalled FROM t",
    "run_progress": f"WITH {TASKS} SELECT run_id, round(sum(CASE WHEN state = 'succeeded' THEN 1.0 WHEN total > 0 THEN least(1.0, greatest(0.0, done / total)) ELSE 0.0 END * weight) / sum(weight), 6) AS progress, bool_or(state = 'running' AND total IS NULL) AS indeterminate FROM t GROUP BY 1",
    "ready_tasks": f"WITH {TASKS} SELECT run_id, task_id FROM t a WHERE state = 'pending' AND (task_id = 1 OR EXISTS (SELECT 1 FROM t b WHERE b.run_id = a.run_id AND b.task_id = a.task_id - 1 AND b.state = 'succeeded'))",
    "skipped_tasks": f"WITH {TASKS} SELECT DISTINCT a.run_id, a.task_id FROM t a JOIN t b ON b.run_id = a.run_id AND b.task_id = a.task_id - 1 WHERE a.state = 'pending' AND b.state = 'failed'",
    "run_states": f"WITH {TASKS} SELECT run_id, CASE WHEN bool_or(state IN ('pending', 'running')) THEN 'running' WHEN bool_or(state = 'failed') THEN 'failed' ELSE 'succeeded' END AS state FROM t GROUP BY 1",
    "blocked_reasons": f"WITH {TASKS}, m AS (SELECT run_id, task_id, list_sort(list_filter([worker, lane], lambda x: x NOT IN ('w1', 'w2', 'gpu', 'io'))) AS m FROM t) SELECT run_id, task_id, coalesce(array_to_string(m, ','), '') AS missing, len(m) > 0 AS blocked FROM m",
    "fair_claim": f"WITH {TASKS} SELECT lane, run_id * 10 + task_id AS task_id, CAST(row_number() OVER (PARTITION BY lane ORDER BY priority DESC, vt, run_id * 10 + task_id) AS INTEGER) AS place FROM t WHERE state = 'pending' QUALIFY place <= CASE lane WHEN 'gpu' THEN 2 ELSE 4 END",
    "latest_rows": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "event_facets": "SELECT DISTINCT lang AS value FROM documents WHERE lang IS NOT NULL ORDER BY 1 LIMIT 500",
    "event_page": "SELECT event_id AS seq, event_type AS event FROM events WHERE event_id > 500 AND (event_type ILIKE '%CLI%' OR props ILIKE '%CLI%') ORDER BY 1 LIMIT 1000",
    "redacted": """SELECT event_id, '{"api_key": "[redacted]", "note": "[redacted]", "k": 1}' AS text FROM events""",
    "error_ratio": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS ratio, count(*) FILTER (event_type = 'error') / count(*) > 0.2 AS firing FROM events GROUP BY 1",
    "watch_counts": "SELECT user_id AS repo_id, 'n' || max(event_id) AS full_name, count(*) AS star_events FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
    "parquet_lookup": "SELECT CAST(o_custkey AS VARCHAR) AS unit_key, o_orderkey, event_type FROM orders JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1) ON o_custkey = user_id",
    "page_manifest": r"SELECT DISTINCT url AS unit_key, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM crawl_pages WHERE url IS NOT NULL",
    "llms_links": "SELECT 'docs/' || doc_id AS unit_key, 'https://h.example/docs/' || doc_id || '.md' AS url, 'a ' || doc_id AS title FROM documents",
    "sitemap_entries": "SELECT 'https://h.example/?a=1&b=' || doc_id AS unit_key, '2024-01-02' AS lastmod FROM documents",
    "stream_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT strftime(s, '%Y-%m-%d') AS day, count(*) AS events FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1",
    "stream_dedup": "SELECT user_id, CAST(1 AS BIGINT) AS rows FROM events GROUP BY 1",
    "session_windows": """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER w >= INTERVAL 2 HOUR AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(CASE WHEN coalesce(fresh, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS starts, count(*) AS events FROM n GROUP BY user_id, k""",
    "order_revenue": "SELECT n_name, o_orderpriority, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "customers_without_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "price_rank": "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part",
    "rollup_counts": "SELECT l_returnflag, l_linestatus, count(*) AS lines, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
}
