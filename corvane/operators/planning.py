"""Which units of work are due: pending selection, calendar keys, backfill windows, shards, splits and the crawl frontier."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import Scratch


def static_unit(spark: SparkSession, store: str, key: str, payload: str = "") -> DataFrame:
    """One unit with a payload given as ``k=v,...``."""
    pairs = dict(p.split("=", 1) for p in payload.split(",") if "=" in p)
    return spark.createDataFrame([(store, key, {k.strip(): v.strip() for k, v in pairs.items()})], "store string, unit_key string, payload map<string,string>")


def pending_predicate(name: str, now: Column | None = None, stages: tuple[str, ...] = (), days: int = 7) -> Column:
    """unseen, token_moved, stage_in, rearm or rotate over columns ingested, upstream, stage and processed_at."""
    if name == "unseen":
        return F.col("ingested").isNull()
    if name == "token_moved":
        return ~F.col("upstream").eqNullSafe(F.col("ingested"))
    if name == "stage_in":
        if not stages:
            raise ValueError("stage_in needs stages")
        return F.col("stage").isin(*stages)
    if name == "rearm":
        return F.col("ingested").isNull() | F.col("processed_at").isNull() | (F.col("processed_at") < now - F.make_dt_interval(F.lit(days)))
    if name == "rotate":
        return F.lit(True)
    raise ValueError(f"unknown predicate {name}")


#: Orders of pending units; the key breaks ties.
ORDERS: dict[str, Callable[[], list[Column]]] = {
    "key": lambda: [F.col("unit_key").asc()],
    "ord": lambda: [F.col("ord").asc_nulls_last(), F.col("unit_key").asc()],
    "processed_at": lambda: [F.col("processed_at").asc_nulls_first(), F.col("unit_key").asc()],
    "stars_desc": lambda: [F.coalesce(F.col("stars"), F.lit(0)).desc(), F.col("unit_key").asc()],
}


def pending_units(units: DataFrame, predicate: Column, order: str = "key", limit: int = 100, emitted: DataFrame | None = None, claimed_before: Column | None = None) -> DataFrame:
    """The first ``limit`` units that are due, without those that were emitted or that someone claimed recently."""
    rows = units.where(predicate)
    if claimed_before is not None:
        rows = rows.where(~F.coalesce((F.col("status") == "processing") & (F.col("claimed_at") >= claimed_before), F.lit(False)))
    if emitted is not None:
        rows = rows.join(emitted.select("store", "unit_key").distinct(), ["store", "unit_key"], "left_anti")
    return rows.orderBy(*ORDERS[order]()).limit(limit)


def claim(units: DataFrame, taken: DataFrame, now: Column) -> DataFrame:
    """Units with those that were taken marked as being processed."""
    got = taken.select("store", "unit_key").withColumn("_mine", F.lit(True))
    rows = units.join(got, ["store", "unit_key"], "left")
    return rows.withColumn("status", F.when(F.col("_mine"), "processing").otherwise(F.col("status"))).withColumn("claimed_at", F.when(F.col("_mine"), now).otherwise(F.col("claimed_at"))).drop("_mine")


def pending_repositories(repos: DataFrame, statuses: tuple[str, ...], least_events: int, limit: int, emitted: DataFrame | None = None, order: str = "stars") -> DataFrame:
    rows = repos.where(F.col("status").isin(*statuses) & (F.col("star_events") >= least_events))
    if emitted is not None:
        rows = rows.join(emitted.select("repo_id").distinct(), "repo_id", "left_anti")
    return rows.orderBy(F.col(order).desc_nulls_last(), "repo_id").limit(limit)


def calendar_keys(spark: SparkSession, today: str, days: int, pattern: str = "yyyy-MM-dd", unit: str = "day", unpadded_hour: bool = False) -> DataFrame:
    """``(unit_key, starts)`` for the trailing window that ends before today; one key per hour, day, month or year.

    With ``unpadded_hour`` the pattern's {h} is the hour without a leading zero.
    """
    step = {"hour": "INTERVAL 1 HOUR"}.get(unit, "INTERVAL 1 DAY")
    span = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp'{today}' - INTERVAL '{days}' DAY, timestamp'{today}' - {step}, {step})")).alias("starts"))
    first = F.date_trunc(unit, "starts")
    key = F.date_format("starts", pattern.replace("{h}", "'{h}'"))
    if unpadded_hour:
        key = F.regexp_replace(key, r"\{h\}", F.hour("starts").cast("string"))
    return span.select(key.alias("unit_key"), first.alias("starts")).distinct()


def backfill_windows(spark: SparkSession, start: str, until: str, unit: str = "month", tail_days: int = 7, floor: str | None = None, today: str | None = None) -> DataFrame:
    """``(unit_key, starts, ends, rolling)``: windows over [start, until], and one rolling tail up to tomorrow that every run repeats."""
    begin = max(start, floor) if floor else start
    step = {"day": "INTERVAL 1 DAY", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[unit]
    days = spark.range(1).select(F.explode(F.expr(f"sequence(trunc_start, date'{until}', {step})".replace("trunc_start", f"cast(date_trunc('{unit}', date'{begin}') as date)"))).alias("s"))
    starts = F.greatest(F.col("s"), F.lit(begin).cast("date"))
    ends = F.least(F.date_sub((F.col("s") + F.expr(step)).cast("date"), 1), F.lit(until).cast("date"))
    rows = days.select(starts.alias("starts"), ends.alias("ends"), F.lit(False).alias("rolling"))
    if today:
        tail = spark.range(1).select(F.greatest(F.date_sub(F.lit(today).cast("date"), tail_days), F.lit(begin).cast("date")).alias("starts"), F.date_add(F.lit(today).cast("date"), 1).alias("ends"), F.lit(True).alias("rolling"))
        rows = rows.union(tail)
    return rows.select(F.concat(F.col("starts").cast("string"), F.lit(".."), F.col("ends").cast("string")).alias("unit_key"), "starts", "ends", "rolling")


def daily_shards(spark: SparkSession, first: str, today: str, threshold: int, have: DataFrame | None = None) -> DataFrame:
    """``(unit_key)`` of the form ``day..day@threshold``, one per day, without those that exist."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{today}', INTERVAL 1 DAY)")).alias("d")).select(F.col("d").cast("string"))
    keys = days.select(F.concat("d", F.lit(".."), "d", F.lit(f"@{threshold}")).alias("unit_key"))
    return keys.join(have.select("unit_key"), "unit_key", "left_anti") if have is not None else keys


def split_range(low: int, high: int, hits: Callable[[int, int], int], cap: int) -> list[tuple[int, int]]:
    """Half-open ranges of at most ``cap`` hits each, by halving; a range of width one is never split."""
    out, waiting = [], [(low, high)]
    while waiting:
        a, b = waiting.pop()
        if hits(a, b) > cap and b - a > 1:
            mid = (a + b) // 2
            waiting += [(mid, b), (a, mid)]
        else:
            out.append((a, b))
    return out


def crawl(seeds: DataFrame, links: DataFrame, depth: int, budget: int) -> DataFrame:
    """``(url, depth)`` of pages reached breadth first: seeds at depth 0, then unseen links, up to ``budget`` pages.

    The level that exceeds the budget is cut in order of the URL. Each level is a join of the frontier with the links,
    written to shared storage.
    """
    scratch = Scratch(seeds.sparkSession, "crawl")

    def within(urls: DataFrame, room: int, d: int) -> tuple[DataFrame, int]:
        level = scratch.keep(urls.select("url", F.lit(d).alias("depth")), "level")
        size = level.count()
        return (level, size) if size <= room else (scratch.keep(level.orderBy("url").limit(room), "level"), room)

    level, count = within(seeds.select("url").distinct(), budget, 0)
    seen = level
    for d in range(1, depth + 1):
        fresh = links.join(level.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        level, found = within(fresh, budget - count, d)
        if not found:
            break
        seen, count = seen.union(level), count + found
    return seen


# --- triggers --------------------------------------------------------------------------------------------------------
#: Bounds of the five fields of a cron line.
_FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


def parse_cron(line: str) -> list[set[int]]:
    """Allowed values of minute, hour, day, month and weekday (0 is Sunday)."""
    parts = line.split()
    if len(parts) != 5:
        raise ValueError("a cron line has five fields")
    out = []
    for text, (name, low, high) in zip(parts, _FIELDS, strict=True):
        allowed: set[int] = set()
        for item in text.split(","):
            span, _, step = item.partition("/")
            if step and (not step.isdigit() or int(step) < 1):
                raise ValueError(f"bad step in {name}")
            a, b = (low, high) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1])) if span.replace("-", "").isdigit() else (None, None)
            if a is None or a < low or b > high or a > b:
                raise ValueError(f"bad {name}: {item}")
            allowed |= set(range(a, (high if step and span.isdigit() else b) + 1, int(step or 1)))
        out.append({x % 7 for x in allowed} if name == "weekday" else allowed)
    return out


def next_fire(spec: dict, after: datetime) -> datetime:
    """The first time strictly after ``after`` (with a zone) for {'cron': line, 'tz': zone} or {'every_seconds': n}.

    Local times that a zone skips don't fire. Missed times aren't made up: the caller asks again from now.
    """
    if "every_seconds" in spec:
        if int(spec["every_seconds"]) <= 0:
            raise ValueError("the interval must be positive")
        return after + timedelta(seconds=int(spec["every_seconds"]))
    from zoneinfo import ZoneInfo

    minute, hour, day, month, weekday = parse_cron(spec["cron"])
    zone = ZoneInfo(spec.get("tz", "UTC"))
    any_day, any_week = spec["cron"].split()[2] == "*", spec["cron"].split()[4] == "*"
    local = after.astimezone(zone).replace(second=0, microsecond=0, tzinfo=None)
    d = local.date()
    for _ in range(366 * 8):
        by_day, by_week = d.day in day, (d.isoweekday() % 7) in weekday
        good = by_day and by_week if any_day or any_week else by_day or by_week
        if d.month in month and good:
            for h in sorted(hour):
                for m in sorted(minute):
                    at = datetime(d.year, d.month, d.day, h, m, tzinfo=zone)
                    real = at.astimezone(timezone.utc).astimezone(zone)
                    if real.replace(tzinfo=None) == at.replace(tzinfo=None) and at > after:
                        return at
        d += timedelta(days=1)
    raise ValueError("the line never fires")


def match_trigger(events: DataFrame, cursor: int, event: str, source: str | None = None) -> DataFrame:
    """The first event after the cursor that a trigger waits for; events of the scheduler itself never match."""
    rows = events.where((F.col("seq") > cursor) & (F.col("event") == event) & (F.coalesce(F.col("origin"), F.lit("")) != "scheduler"))
    if source is not None:
        rows = rows.where(F.col("source") == source)
    return rows.orderBy("seq").limit(1)


def as_date(text: str) -> date:
    return date.fromisoformat(text)
