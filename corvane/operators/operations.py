"""Operational aggregates over logs and state tables. Every query takes the present time as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latency(log: DataFrame, ts: str, ms: str, degraded: Column, start: Column, end: Column) -> DataFrame:
    """Count, degraded count and share, exact percentiles of a window; one row."""
    rows = log.where((F.col(ts) >= start) & (F.col(ts) < end))
    q = lambda p: F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {ms})")
    return rows.agg(
        F.count("*").alias("searches"), F.count_if(degraded).alias("degraded"), F.round(100.0 * F.count_if(degraded) / F.greatest(F.count("*"), F.lit(1)), 1).alias("degraded_pct"),
        q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"),
    )


def retain(log: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return log.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def state_counts(table: DataFrame, *by: str) -> DataFrame:
    return table.groupBy(*by).agg(F.count("*").alias("rows"))


def recent_rates(events: DataFrame, groups: DataFrame, by: str, ts: str, now: Column, what: Column) -> DataFrame:
    """Events a minute over the last two and ten minutes for every group, also those without events."""
    minutes = lambda m: now - F.make_dt_interval(mins=F.lit(m))
    rows = events.where(what & (F.col(ts) >= minutes(10)) & (F.col(ts) <= now)).groupBy(by).agg(
        F.count_if(F.col(ts) >= minutes(2)).alias("two"), F.count("*").alias("ten")
    )
    out = groups.select(by).distinct().join(rows, by, "left")
    return out.select(by, (F.coalesce("two", F.lit(0)) / 2.0).alias("per_minute_2m"), (F.coalesce("ten", F.lit(0)) / 10.0).alias("per_minute_10m"))


def worker_snapshot(tasks: DataFrame, now: Column, stalled_seconds: int) -> DataFrame:
    """Running tasks, workers, oldest start, stalest heartbeat and whether claims stall although work is ready; one row."""
    running = F.col("state") == "running"
    age = lambda c: F.unix_timestamp(now) - F.unix_timestamp(F.min(F.when(running, F.col(c))))
    out = tasks.agg(
        F.count_if(running).alias("running"), F.count_if(F.col("state") == "ready").alias("ready"), F.count_distinct(F.when(running, F.col("worker"))).alias("workers"),
        age("started_at").alias("oldest_running_s"), age("heartbeat_at").alias("stalest_heartbeat_s"), (F.unix_timestamp(now) - F.unix_timestamp(F.max("claimed_at"))).alias("since_claim_s"),
    )
    return out.withColumn("claim_stalled", (F.col("ready") > 0) & (F.col("running") == 0) & (F.coalesce("since_claim_s", F.lit(2**31)) > stalled_seconds))


def scheduler_lag(triggers: DataFrame, now: Column) -> DataFrame:
    due = F.col("enabled") & (F.col("next_fire_at") <= now)
    return triggers.agg(F.count_if(due).alias("due"), F.coalesce(F.max(F.when(due, F.unix_timestamp(now) - F.unix_timestamp("next_fire_at"))), F.lit(0)).alias("lag_s"))


def latest(table: DataFrame, by: str, order: str) -> DataFrame:
    """The row of each group with the greatest ``order``; an aggregate, so no group is sorted."""
    rest = [c for c in table.columns if c != by]
    return table.groupBy(by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(by, "r.*")


def run_progress(tasks: DataFrame) -> DataFrame:
    """``(run_id, progress, indeterminate)``: share of done work weighted by task, clamped to [0, 1], six digits.

    A finished task counts whole, one with an unknown total not at all while it runs; such a run is indeterminate.
    """
    done = F.col("state").isin("succeeded", "skipped")
    known = F.coalesce(F.col("units_total"), F.lit(0)) > 0
    part = F.when(done, 1.0).when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("units_done") / F.col("units_total")))).otherwise(0.0)
    return tasks.groupBy("run_id").agg(
        F.round(F.coalesce(F.sum(part * F.col("weight")) / F.sum("weight"), F.lit(0.0)), 6).alias("progress"), F.bool_or((F.col("state") == "running") & ~known).alias("indeterminate")
    )


def source_overview(sources: DataFrame, docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents, searchable ones, last indexing and last and current run of every source."""
    d = docs.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "searchable").alias("searchable"), F.max("indexed_at").alias("last_indexed"))
    r = runs.groupBy("source").agg(F.max("started_at").alias("last_run"), F.count_if(F.col("state").isin("pending", "running")).alias("active_runs"))
    out = sources.select("source").join(d, "source", "left").join(r, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source", zero("documents"), zero("searchable"), "last_indexed", "last_run", zero("active_runs"))


def event_page(events: DataFrame, after: int = 0, limit: int = 100, text: str | None = None, since: Column | None = None, until: Column | None = None, **equal: str | None) -> DataFrame:
    """Events after a cursor in order of seq, by any of the equality conditions and a case-insensitive search in message and name."""
    rows = events.where(F.col("seq") > after)
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    if until is not None:
        rows = rows.where(F.col("ts") < until)
    if text:
        like = "%" + text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"
        rows = rows.where(F.col("message").ilike(like) | F.col("event").ilike(like))
    return rows.orderBy("seq").limit(max(1, min(limit, 1000)))


def facet(events: DataFrame, column: str, limit: int = 500) -> DataFrame:
    return events.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value").limit(limit)


#: Names of fields, and forms of values, that are secrets.
SECRET_NAMES = r"(?i)(\"[^\"]*(?:password|passwd|secret|token|api[_-]?key|authorization|cookie|credential)[^\"]*\"\s*:\s*)(\"(?:[^\"\\]|\\.)*\"|[^,}\]\s]+)"
SECRET_FORMS = r"(?i)\b(?:bearer\s+[A-Za-z0-9._~+/=-]{8,}|gh[pousr]_[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,})"


def redact(json: Column) -> Column:
    """JSON text with the values of secret fields, and whatever looks like a token, replaced."""
    return F.regexp_replace(F.regexp_replace(json, SECRET_NAMES, '$1"[redacted]"'), SECRET_FORMS, "[redacted]")


def ratio_alert(metrics: DataFrame, part: str, whole: str, limit: float, least: float = 1.0) -> DataFrame:
    """Rows with ``ratio`` = part over whole (at least ``least``) and whether it is above the limit."""
    ratio = F.col(part) / F.greatest(F.col(whole).cast("double"), F.lit(least))
    return metrics.withColumn("ratio", F.round(ratio, 6)).withColumn("firing", ratio > limit)


# --- runs and tasks --------------------------------------------------------------------------------------------------
def ready_tasks(tasks: DataFrame) -> DataFrame:
    """``(run_id, task_id)`` of pending tasks whose dependencies have all succeeded or were skipped."""
    pending = tasks.where(F.col("state") == "pending")
    needs = pending.select("run_id", "task_id", F.explode("depends_on").alias("need"))
    met = tasks.where(F.col("state").isin("succeeded", "skipped")).select("run_id", F.col("task_id").alias("need"))
    unmet = needs.join(met, ["run_id", "need"], "left_anti").select("run_id", "task_id")
    return pending.select("run_id", "task_id").join(unmet, ["run_id", "task_id"], "left_anti")


def skipped_tasks(tasks: DataFrame) -> DataFrame:
    """``(run_id, task_id)`` of pending tasks with a failed, cancelled or skipped-by-failure dependency one step away."""
    pending = tasks.where(F.col("state") == "pending")
    needs = pending.select("run_id", "task_id", F.explode("depends_on").alias("need"))
    bad = tasks.where(F.col("state").isin("failed", "cancelled")).select("run_id", F.col("task_id").alias("need"))
    return needs.join(bad, ["run_id", "need"], "left_semi").select("run_id", "task_id").distinct()


def run_states(tasks: DataFrame) -> DataFrame:
    """``(run_id, state)``: running while anything is open, else failed, cancelled or succeeded."""
    s = F.col("state")
    return tasks.groupBy("run_id").agg(
        F.when(F.bool_or(s.isin("pending", "ready", "running")), "running").when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s == "cancelled"), "cancelled").otherwise("succeeded").alias("state")
    )


def blocked_reasons(tasks: DataFrame, have: list[str]) -> DataFrame:
    """``(run_id, task_id, missing, blocked)``: preconditions that aren't there; empty lists block nothing."""
    missing = F.array_except(F.coalesce("preconditions", F.array().cast("array<string>")), F.array(*map(F.lit, have)).cast("array<string>"))
    return tasks.select("run_id", "task_id", F.array_sort(missing).alias("missing"), (F.size(missing) > 0).alias("blocked"))


def fair_claim(tasks: DataFrame, lanes: dict[str, int], running: DataFrame) -> DataFrame:
    """Ready tasks that may start now: per lane as many as its cap has free, by priority, then virtual time, then id."""
    caps = F.create_map(*[x for lane, cap in lanes.items() for x in (F.lit(lane), F.lit(cap))])
    used = running.groupBy("lane").agg(F.count("*").alias("used"))
    at = Window.partitionBy("lane").orderBy(F.col("priority").desc(), F.col("virtual_time"), F.col("task_id"))
    rows = tasks.where(F.col("state") == "ready").join(used, "lane", "left").withColumn("place", F.row_number().over(at))
    return rows.where(F.col("place") <= F.coalesce(caps[F.col("lane")], F.lit(0)) - F.coalesce("used", F.lit(0))).drop("used")


def expired_leases(tasks: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """The running tasks whose lease is over, oldest first, with the state they go to."""
    rows = tasks.where((F.col("state") == "running") & (F.col("lease_until") < now)).orderBy("lease_until", "task_id").limit(limit)
    return rows.withColumn("next_state", F.when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("ready"))


def collect_garbage(files: DataFrame, referenced: DataFrame, now: Column, min_age_days: int, max_files: int, max_bytes: int) -> DataFrame:
    """Unreferenced files that are old enough, oldest first, within a cap of files and of bytes.

    A file that would pass the byte cap is skipped and later smaller ones may still fit, so the walk is sequential; it
    runs over at most ``max_files`` * 4 candidates, a bounded list.
    """
    free = files.join(referenced.select("path"), "path", "left_anti").where(F.col("modified") < now - F.make_dt_interval(F.lit(min_age_days)))
    rows = free.orderBy("modified", "path").limit(max_files * 4)
    out, total = [], 0
    for r in rows.collect():
        if len(out) == max_files:
            break
        if total + r["size"] <= max_bytes:
            out.append(r)
            total += r["size"]
    return files.sparkSession.createDataFrame(out, rows.schema)
