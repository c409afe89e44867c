"""URL expressions by regular expression: they accept what strict parsers reject, and stay in generated code.

A URL is split as scheme, authority, path, query and fragment (RFC 3986, appendix B).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import text_hash
from corvane.session import WHITE

SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Query keys that say where a visitor came from; first rule by pattern, second by name.
NEWS_TRACKING = r"^(utm_|fbclid|gclid|mc_cid|mc_eid|ref$)"
CRAWL_TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "mc_cid", "mc_eid",
    "ref", "ref_src", "source", "_ga", "igshid", "si",
)


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; '' where missing."""
    return F.regexp_extract(F.regexp_replace(url, f"^{WHITE}|{WHITE}$", ""), SPLIT, k)


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::\d*)?$", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(part(url, 2), r":(\d+)$", 1)


def canonical_news(url: Column) -> Column:
    """Scheme (default https) and host in lower case, tracking and blank parameters dropped, order kept, no fragment, no final slash."""
    scheme = F.when(part(url, 1) == "", F.lit("https")).otherwise(F.lower(part(url, 1)))
    path = F.regexp_replace(part(url, 3), "/+$", "")
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: F.regexp_like(p, F.lit("^[^=]+=.+$")) & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).rlike(NEWS_TRACKING))
    query = F.array_join(pairs, "&")
    return F.concat(scheme, F.lit("://"), F.lower(part(url, 2)), F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def canonical_crawl(url: Column) -> Column:
    """Scheme and host in lower case, user and default port dropped, named tracking parameters dropped, the rest sorted; path as it is."""
    scheme, p = F.lower(part(url, 1)), port(url)
    default = (p == "") | ((scheme == "http") & (p == "80")) | ((scheme == "https") & (p == "443"))
    pairs = F.filter(F.split(part(url, 4), "&"), lambda x: (x != "") & ~F.lower(F.split_part(x, F.lit("="), F.lit(1))).isin(*CRAWL_TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    path = F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))
    return F.concat(scheme, F.lit("://"), host(url), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), p)), path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def sha1_suffix(canonical: Column) -> Column:
    return F.substring(F.sha1(canonical), 1, 20)


def path_suffix(url: Column) -> Column:
    """Stable suffix of a crawled page: path and query without the first slash, 'index' where empty, bounded in length."""
    query = part(url, 4)
    tail = F.concat(F.regexp_replace(part(url, 3), "^/+", ""), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    tail = F.when(tail == "", F.lit("index")).otherwise(tail)
    return F.when(F.length(tail) > 200, F.concat(F.substring(tail, 1, 160), F.lit("~"), F.substring(text_hash(url), 1, 16))).otherwise(tail)


def site(url: Column) -> Column:
    """Host without a leading www., for comparing hosts."""
    return F.regexp_replace(host(url), r"^www\.", "")


def same_host(a: Column, b: Column) -> Column:
    return site(a) == site(b)


@dataclass(frozen=True)
class Scope:
    """Which URLs a crawl may follow. Exclude patterns win over include patterns; both look at path and query."""

    same_host: bool = True
    path_prefix: str = ""
    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())

    def reason(self, url: Column, seed: Column) -> Column:
        """'' where a URL is in scope, else the rule that rejects it: scheme, host, prefix, exclude or include."""
        query = part(url, 4)
        target = F.concat(part(url, 3), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
        out = F.when(~F.lower(part(url, 1)).isin("http", "https"), "scheme")
        if self.same_host:
            out = out.when(~same_host(url, seed), "host")
        if self.path_prefix:
            out = out.when(~part(url, 3).startswith(self.path_prefix), "prefix")
        for pattern in self.exclude:
            out = out.when(target.rlike(pattern), "exclude")
        if self.include:
            hit = F.lit(False)
            for pattern in self.include:
                hit = hit | target.rlike(pattern)
            out = out.when(~hit, "include")
        return out.otherwise("")


def dominant_prefix(df: DataFrame, url: str, group: str) -> DataFrame:
    """``(group, prefix, urls)``: first path segment that more than half of a group's URLs with a path share."""
    rows = df.select(group, F.regexp_extract(part(F.col(url), 3), "^/*([^/]+)", 1).alias("segment")).where("segment <> ''")
    counts = rows.groupBy(group, "segment").agg(F.count("*").alias("urls"))
    totals = counts.groupBy(group).agg(F.sum("urls").alias("every"), F.max(F.struct("urls", "segment")).alias("top"))
    return totals.where(F.col("top.urls") * 2 > F.col("every")).select(group, F.concat(F.lit("/"), F.col("top.segment"), F.lit("/")).alias("prefix"), F.col("top.urls").alias("urls"))
