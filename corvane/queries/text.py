"""Text, URL and date expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import dates, text, urls
from corvane.session import WHITE, read

#: The same white space for SQL.
W = WHITE
INV = text.INVISIBLE


def text_hash_docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.text_hash(F.col("text")).alias("hash"))


def text_hash_stale(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose stored hash isn't the hash of their text."""
    rows = read(spark, d, "documents").select("doc_id", text.text_hash(F.col("text")).alias("hash"), F.lower("text_hash").alias("stored"))
    return rows.where(F.col("hash").isNotNull() & ~F.col("stored").eqNullSafe(F.col("hash"))).select("doc_id")


def sanitize_docs(spark: SparkSession, d: str) -> DataFrame:
    clean = text.sanitize(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(clean).alias("clean"), F.length(clean).cast("bigint").alias("chars"))


def empty_guard(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(text.is_blank(F.col("text"))).select("doc_id")


def readme_clean(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.clean_readme(F.col("text"))).alias("clean"))


def fragment_clean(spark: SparkSession, d: str) -> DataFrame:
    """Comment fragments made of the documents' lines."""
    html = F.concat(F.lit("<p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit("<p>")), F.lit(" <i>x &gt; y</i>"))
    return read(spark, d, "documents").select("doc_id", F.md5(text.clean_fragment(html)).alias("clean"))


def junk_docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(text.is_junk(F.col("text"))).select("doc_id")


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.snippet(F.col("title"), F.col("text")).alias("snippet"))


def composed(spark: SparkSession, d: str) -> DataFrame:
    whole = text.compose_text(F.col("title"), F.col("text"), 512)
    return read(spark, d, "documents").select("doc_id", F.md5(whole).alias("body"), F.length(whole).cast("bigint").alias("chars"))


def compose_repository(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").where("source = 'github_readmes'")
    whole = text.compose_repository(F.col("id"), F.col("title"), F.array("source", "lang"), F.col("text"))
    return rows.select("doc_id", F.md5(whole).alias("body"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.size(text.words(F.col("text"))).cast("bigint").alias("words"))


def canonical_news(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", urls.canonical_news(F.col("url")).alias("canonical"))


def canonical_crawl(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "crawl_pages").select("page_id", urls.canonical_crawl(F.col("url")).alias("canonical"))


def suffix_sha1(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", urls.sha1_suffix(urls.canonical_news(F.col("url"))).alias("suffix"))


def suffix_path(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "crawl_pages").select("page_id", urls.path_suffix(F.col("url")).alias("suffix"))


def same_host(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "crawl_pages").select("page_id", F.coalesce(urls.same_host(F.col("url"), F.col("canonical_url")), F.lit(False)).alias("same"))


def scope_reason(spark: SparkSession, d: str) -> DataFrame:
    scope = urls.Scope(path_prefix="/", include=(r"/p\d+",), exclude=(r"utm_",))
    return read(spark, d, "crawl_pages").select("page_id", scope.reason(F.col("url"), F.lit("https://wiki-lumen.example/")).alias("reason"))


def suggest_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").withColumn("made", F.concat(F.lit("https://h.example/"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise(F.lit("x")), F.lit("/"), F.col("doc_id").cast("string")))
    return urls.dominant_prefix(rows, "made", "source")


def date_clamp(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2023-06-01 00:00:00").cast("timestamp")
    return read(spark, d, "documents").select("doc_id", F.unix_micros(dates.clamp_date(F.col("published_at"), now)).alias("published_us")).where("published_us IS NOT NULL")


QUERIES = {f.__name__: f for f in (
    text_hash_docs, text_hash_stale, sanitize_docs, empty_guard, readme_clean, fragment_clean, junk_docs, snippets, composed, compose_repository, word_counts,
    canonical_news, canonical_crawl, suffix_sha1, suffix_path, same_host, scope_reason, suggest_prefix, date_clamp,
)}

HASH = f"sha1(trim(regexp_replace(lower(text), '{W}', ' ', 'g')))"
SANE = f"regexp_replace(text, '{INV}', '', 'g')"
PARTS = r"""
    parts AS (
      SELECT *, regexp_extract(u, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', ['scheme','auth','path','query','frag']) AS p FROM src
    )"""
NEWS = r"""
    (CASE WHEN p.scheme = '' THEN 'https' ELSE lower(p.scheme) END) || '://' || lower(p.auth) ||
    (CASE WHEN regexp_replace(p.path, '/+$', '') = '' THEN '/' ELSE regexp_replace(p.path, '/+$', '') END) ||
    (CASE WHEN coalesce(array_to_string(list_filter(string_split(p.query, '&'), lambda x: regexp_matches(x, '^[^=]+=.+$') AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_|fbclid|gclid|mc_cid|mc_eid|ref$)')), '&'), '') = '' THEN ''
     ELSE '?' || array_to_string(list_filter(string_split(p.query, '&'), lambda x: regexp_matches(x, '^[^=]+=.+$') AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_|fbclid|gclid|mc_cid|mc_eid|ref$)')), '&') END)"""
TRACK = ", ".join(f"'{x}'" for x in urls.CRAWL_TRACKING)
CRAWL = f"""
    lower(p.scheme) || '://' || lower(regexp_extract(p.auth, '^(?:.*@)?([^:]*)(?::\\d*)?$', 1)) ||
    (CASE WHEN regexp_extract(p.auth, ':(\\d+)$', 1) = '' OR (lower(p.scheme) = 'http' AND regexp_extract(p.auth, ':(\\d+)$', 1) = '80') OR (lower(p.scheme) = 'https' AND regexp_extract(p.auth, ':(\\d+)$', 1) = '443')
     THEN '' ELSE ':' || regexp_extract(p.auth, ':(\\d+)$', 1) END) || (CASE WHEN p.path = '' THEN '/' ELSE p.path END) ||
    (CASE WHEN len(list_filter(string_split(p.query, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({TRACK}))) = 0 THEN ''
     ELSE '?' || array_to_string(list_sort(list_filter(string_split(p.query, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({TRACK}))), '&') END)"""
README = SANE
for _p, _n in text.README_RULES:
    README = f"regexp_replace({README}, '{_p}', '{_n.replace('$1', chr(92) + '1')}', 'g')"
README = f"regexp_replace(regexp_replace({README}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
FRAGMENT = "regexp_replace(regexp_replace(regexp_replace(h, '\\x00', '', 'g'), '(?i)<p[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g')"
for _a, _b in text.ENTITIES:
    FRAGMENT = f"replace({FRAGMENT}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
SITE = lambda c: f"regexp_replace(lower(regexp_extract(regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^(?:.*@)?([^:]*)(?::\\d*)?$', 1)), '^www\\.', '')"
TITLED = "CASE WHEN title IS NOT NULL AND title <> '' AND text IS NOT NULL THEN title || chr(10) || chr(10) || text WHEN title IS NOT NULL AND title <> '' THEN title ELSE coalesce(text, '') END"

SQL = {
    "text_hash_docs": f"SELECT doc_id, {HASH} AS hash FROM documents",
    "text_hash_stale": f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND lower(text_hash) IS DISTINCT FROM {HASH}",
    "sanitize_docs": f"SELECT doc_id, md5({SANE}) AS clean, CAST(length({SANE}) AS BIGINT) AS chars FROM documents",
    "empty_guard": f"SELECT doc_id FROM documents WHERE text IS NULL OR regexp_replace({SANE}, '{W}', '', 'g') = ''",
    "readme_clean": f"SELECT doc_id, md5(regexp_replace({README}, '^{W}|{W}$', '', 'g')) AS clean FROM documents",
    "fragment_clean": f"""
        WITH f AS (SELECT doc_id, '<p>' || replace(replace(text, '&', '&amp;'), chr(10), '<p>') || ' <i>x &gt; y</i>' AS h FROM documents),
        t AS (SELECT doc_id, {FRAGMENT} AS t FROM f),
        l AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '{W}', ' ', 'g'))), chr(10)) AS t FROM t)
        SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')) AS clean FROM l""",
    "junk_docs": f"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^{W}|{W}$', '', 'g') AS t FROM documents)
        SELECT doc_id FROM t WHERE length(t) < 20 OR len(regexp_extract_all(t, '{text.MARKUP}')) >= 3
          OR length(array_to_string(regexp_extract_all(t, '[A-Za-z][A-Za-z''-]+'), '')) / greatest(length(t), 1) < 0.45""",
    "snippets": f"SELECT doc_id, substr({TITLED}, 1, 400) AS snippet FROM documents",
    "composed": f"SELECT doc_id, md5(substr(regexp_replace({TITLED}, '{INV}', '', 'g'), 1, 2048)) AS body, CAST(length(substr(regexp_replace({TITLED}, '{INV}', '', 'g'), 1, 2048)) AS BIGINT) AS chars FROM documents",
    "compose_repository": f"""
        SELECT doc_id, md5(substr(regexp_replace(array_to_string(list_filter([replace(id, '/', ' / '), nullif(title, ''), 'Topics: ' || array_to_string(list_filter([source, lang], lambda x: x IS NOT NULL), ', '), nullif(text, '')],
          lambda x: x IS NOT NULL), chr(10) || chr(10)), '{INV}', '', 'g'), 1, 100000)) AS body FROM documents WHERE source = 'github_readmes'""",
    "word_counts": r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '')) AS BIGINT) AS words FROM documents",
    "canonical_news": f"WITH src AS (SELECT doc_id, regexp_replace(url, '^{W}|{W}$', '', 'g') AS u FROM documents), {PARTS} SELECT doc_id, {NEWS} AS canonical FROM parts",
    "canonical_crawl": f"WITH src AS (SELECT page_id, regexp_replace(url, '^{W}|{W}$', '', 'g') AS u FROM crawl_pages), {PARTS} SELECT page_id, {CRAWL} AS canonical FROM parts",
    "suffix_sha1": f"WITH src AS (SELECT doc_id, regexp_replace(url, '^{W}|{W}$', '', 'g') AS u FROM documents), {PARTS} SELECT doc_id, substr(sha1({NEWS}), 1, 20) AS suffix FROM parts",
    "suffix_path": f"""
        WITH src AS (SELECT page_id, url AS u FROM crawl_pages), {PARTS},
        t AS (SELECT page_id, u, coalesce(nullif(regexp_replace(p.path, '^/+', '') || CASE WHEN p.query = '' THEN '' ELSE '?' || p.query END, ''), 'index') AS t FROM parts)
        SELECT page_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 160) || '~' || substr(sha1(trim(regexp_replace(lower(u), '{W}', ' ', 'g'))), 1, 16) ELSE t END AS suffix FROM t""",
    "same_host": f"SELECT page_id, coalesce({SITE('url')} = {SITE('canonical_url')}, false) AS same FROM crawl_pages",
    "scope_reason": f"""
        WITH src AS (SELECT page_id, url AS u FROM crawl_pages), {PARTS},
        t AS (SELECT page_id, u, p, p.path || CASE WHEN p.query = '' THEN '' ELSE '?' || p.query END AS target FROM parts)
        SELECT page_id, CASE WHEN lower(p.scheme) NOT IN ('http', 'https') THEN 'scheme' WHEN {SITE('u')} <> 'wiki-lumen.example' THEN 'host' WHEN NOT starts_with(p.path, '/') THEN 'prefix'
          WHEN regexp_matches(target, 'utm_') THEN 'exclude' WHEN NOT regexp_matches(target, '/p\\d+') THEN 'include' ELSE '' END AS reason FROM t""",
    "suggest_prefix": """
        WITH s AS (SELECT source, CASE WHEN doc_id % 3 > 0 THEN source ELSE 'x' END AS segment FROM documents), c AS (SELECT source, segment, count(*) AS urls FROM s GROUP BY 1, 2)
        SELECT source, '/' || segment || '/' AS prefix, urls FROM (SELECT *, sum(urls) OVER (PARTITION BY source) AS every, row_number() OVER (PARTITION BY source ORDER BY urls DESC, segment DESC) AS r FROM c) WHERE r = 1 AND urls * 2 > every""",
    "date_clamp": """
        SELECT doc_id, epoch_us(published_at) AS published_us FROM documents WHERE published_at BETWEEN TIMESTAMPTZ '1990-01-01 00:00:00+00' AND TIMESTAMPTZ '2023-06-03 00:00:00+00'""",
}
