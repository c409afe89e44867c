"""Listings to assertions about what exists upstream: URL lists, manifests, sitemaps, indexes, events and search results.

Each parser takes a DataFrame of bodies, one row per fetched blob, in a string column ``body``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.urls import Scope, canonical_crawl, part


def trimmed_lines(body: DataFrame, column: str = "body") -> DataFrame:
    """``(blob, no, line)`` of all lines, trimmed; ``blob`` is the row's own key where it has one."""
    key = F.col("blob") if "blob" in body.columns else F.lit(0).alias("blob")
    return body.select(key, F.posexplode(F.split(F.col(column), r"\r\n|\r|\n")).alias("no", "line")).select("blob", "no", F.trim("line").alias("line"))


def url_list(body: DataFrame, schemes: tuple[str, ...] = ("http", "https"), shrink_floor: int = 200) -> DataFrame:
    """``(unit_key, host)``: one URL per line; blank lines, comments, repeats and other schemes are left out.

    A list that shrank below the floor is taken for broken and raises.
    """
    rows = trimmed_lines(body).where("line <> '' AND NOT startswith(line, '#')").select("line")
    rows = rows.where(F.lower(part(F.col("line"), 1)).isin(*schemes) & (part(F.col("line"), 2) != "")).distinct()
    out = rows.select(F.col("line").alias("unit_key"), F.lower(part(F.col("line"), 2)).alias("host"))
    count = out.count()
    if count < shrink_floor:
        raise ValueError(f"the list has {count} entries, fewer than {shrink_floor}")
    return out


def json_manifest(body: DataFrame, key_field: str, upstream_field: str = "", slugs: tuple[str, ...] = (), scope_prefix: str = "") -> DataFrame:
    """``(unit_key, upstream, id_scope, payload)`` of the objects of a JSON array; those without a key are left out."""
    entry = F.explode(F.from_json("body", "array<string>", {"mode": "FAILFAST"})).alias("payload")
    rows = body.select(entry).withColumn("unit_key", F.get_json_object("payload", f"$.{key_field}")).where("unit_key IS NOT NULL AND unit_key <> ''")
    if slugs:
        rows = rows.where(F.col("unit_key").isin(*slugs))
    upstream = F.get_json_object("payload", f"$.{upstream_field}") if upstream_field else F.lit(None).cast("string")
    scope = F.concat(F.lit(scope_prefix), "unit_key", F.lit("/")) if scope_prefix else F.lit(None).cast("string")
    return rows.select("unit_key", upstream.alias("upstream"), scope.alias("id_scope"), "payload")


def path_manifest(lines: DataFrame, patterns: tuple[str, ...] = (), today: str | None = None, min_age: int = 0, max_age: int = 0) -> DataFrame:
    """``(unit_key, published)`` of paths, one per line; the date in the path decides age. Read gzip with ``spark.read.text``."""
    rows = lines.select(F.trim("value").alias("unit_key")).where("unit_key <> ''").distinct()
    for k, p in enumerate(patterns):
        hit = F.col("unit_key").rlike(p) if k == 0 else hit | F.col("unit_key").rlike(p)
    if patterns:
        rows = rows.where(hit)
    form = r"(20\d{2})/?([01]\d)/?([0-3]\d)"
    day = F.concat_ws("-", *[F.regexp_extract("unit_key", form, k) for k in (1, 2, 3)])
    rows = rows.withColumn("published", F.try_to_timestamp(F.when(F.length(day) == 10, day), F.lit("yyyy-MM-dd")).cast("date"))
    if min_age:
        rows = rows.where(F.col("published") <= F.date_sub(F.lit(today).cast("date"), min_age))
    if max_age:
        rows = rows.where(F.col("published") >= F.date_sub(F.lit(today).cast("date"), max_age))
    return rows


def sitemap(body: DataFrame) -> DataFrame:
    """``(unit_key, lastmod)`` of the url entries of a sitemap."""
    entry = F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<url>(.*?)</url>"), 1)).alias("entry")
    tag = lambda name: F.trim(F.regexp_extract("entry", rf"(?s)<{name}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1))
    rows = body.select(entry).select(F.regexp_replace(tag("loc"), "&amp;", "&").alias("unit_key"), F.nullif(tag("lastmod"), F.lit("")).alias("lastmod"))
    return rows.where("unit_key <> ''").distinct()


def apache_index(body: DataFrame, patterns: tuple[str, ...] = (), marker: str = "", date: str = "") -> DataFrame:
    """``(unit_key, bytes)`` of the archives of a directory listing; nothing while the marker file is missing."""
    rows = body.where(F.regexp_like("body", F.lit(rf"href=[\"'][^\"']*{marker}[\"']"))) if marker else body
    line = F.explode(F.regexp_extract_all("body", F.lit(r"(?i)(href=[\"'][^\"']+\.(?:bz2|gz)[\"'][^>]*>[^\n]*)"), 1)).alias("line")
    rows = rows.select(line).select(F.regexp_extract("line", r"(?i)href=[\"'](?:[^\"']*/)?([^\"'/]+)[\"']", 1).alias("unit_key"), F.regexp_extract("line", r"(?i)</a>\s+\S+\s+\S+\s+(\d+)", 1).try_cast("bigint").alias("bytes"))
    for p in patterns:
        rows = rows.where(F.col("unit_key").rlike(p))
    if date:
        rows = rows.where(F.col("unit_key").contains(date))
    return rows.distinct()


def llms_txt(body: DataFrame) -> DataFrame:
    """``(unit_key, url, title)`` of the links of an llms.txt file; the key is the path without .md."""
    form = r"(?m)^\s*-\s*\[([^\]]*)\]\((https?://\S+?)\)\s*$"
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(form), 1).alias("title"), F.regexp_extract_all("body", F.lit(form), 2).alias("url"))
    rows = body.select(F.explode(pairs).alias("p")).select(F.trim("p.title").alias("title"), F.col("p.url").alias("url"))
    return rows.select(F.regexp_replace(F.regexp_replace(part(F.col("url"), 3), "^/+|/+$", ""), r"\.md$", "").alias("unit_key"), "url", "title")


def watch_events(lines: DataFrame) -> DataFrame:
    """``(repo_id, full_name, star_events)`` from event lines; the latest name wins. Lines without the type aren't parsed."""
    rows = lines.where(F.col("value").contains("WatchEvent")).select("ordinal", F.from_json("value", "type string, repo struct<id:bigint,name:string>").alias("e"))
    rows = rows.where("e.type = 'WatchEvent' AND e.repo.id IS NOT NULL")
    return rows.groupBy(F.col("e.repo.id").alias("repo_id")).agg(F.max_by("e.repo.name", "ordinal").alias("full_name"), F.count("*").alias("star_events"))


_REPO = "id bigint, full_name string, description string, stargazers_count bigint, topics array<string>, language string"


def search_items(body: DataFrame) -> DataFrame:
    """Repositories of a search page; id and full name are required."""
    rows = body.select(F.explode(F.from_json("body", f"items array<struct<{_REPO.replace(' ', ':').replace(',:', ',')}>>")["items"]).alias("i"))
    return rows.where("i.id IS NOT NULL AND coalesce(i.full_name, '') <> ''").select(
        F.col("i.id").alias("repo_id"), "i.full_name", "i.description", F.col("i.stargazers_count").alias("stars"), "i.topics", "i.language"
    )


def hydrated_repositories(rows: DataFrame, least_stars: int) -> DataFrame:
    """Stage of hydrated repositories: gone without a node, below_threshold, else hydrated; the first README that isn't empty."""
    readme = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("readme_upper", "readme_lower", "readme_plain")])
    stage = F.when(F.col("stars").isNull(), "gone").when(F.col("stars") < least_stars, "below_threshold").otherwise("hydrated")
    return rows.select("repo_id", "full_name", "stars", readme.alias("readme"), stage.alias("stage"))


def feed_entries(entries: DataFrame, most: int, feed: str = "feed", order: str = "position") -> DataFrame:
    """The first entries of each feed in document order, keyed by their canonical link."""
    at = Window.partitionBy(feed).orderBy(order)
    rows = entries.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= most).drop("_n")
    return rows.withColumn("unit_key", canonical_crawl(F.col("link")))


def crawl_links(links: DataFrame, scope: Scope, max_depth: int) -> DataFrame:
    """Links one level deeper that a scope allows, with the reason of the others: (src, dst, seed, depth) in."""
    rows = links.where(F.col("depth") < max_depth).withColumn("unit_key", canonical_crawl(F.col("dst")))
    return rows.withColumn("reason", scope.reason(F.col("unit_key"), F.col("seed"))).withColumn("depth", F.col("depth") + 1)


def parquet_lookup(units: DataFrame, sidecar: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """Units with the value of their key in a side table; the last of repeated keys wins, units without one are left out.

    Only key and value are read from the side table.
    """
    last = sidecar.groupBy(F.col(key).alias("unit_key")).agg(F.max_by(value, F.col(order) if order else F.col(value)).alias(value))
    return units.join(last, "unit_key")


def json_field(column: Column, name: str) -> Column:
    return F.get_json_object(column, f"$.{name}")
