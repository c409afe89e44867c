"""Bodies to documents: HTML, feeds, harvested XML, API rows, dumps and archives.

HTML goes through one Arrow pass over the standard library's parser; everything else is built-in expressions.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import clean_fragment, clean_title, text_hash
from corvane.functions.urls import canonical_news, sha1_suffix

#: Elements that hold no document text, that have no end tag, and that break a line.
CHROME = {"script", "style", "nav", "header", "footer", "aside", "noscript", "form", "svg", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"p", "div", "section", "article", "main", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "br", "hr", "dd", "dt", "dl", "figure", "figcaption", "td", "th"}
ENOUGH = 2000


class _Tree(HTMLParser):
    """Text of the page and of each container that may hold the main text, without what stands in chrome elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.skip = 0
        self.parts: dict[str, list[str]] = {"body": []}
        self.inside: list[tuple[int, str]] = []  # depth at which a container began, and its name
        self.seen: set[str] = set()
        self.title, self.heading, self.in_title, self.in_heading = "", "", False, False
        self.canonical, self.og_url, self.base = "", "", ""
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: (v or "") for k, v in attrs}
        if tag == "link" and a.get("rel", "").lower() == "canonical" and not self.canonical:
            self.canonical = a.get("href", "").strip()
        elif tag == "meta" and a.get("property") == "og:url" and not self.og_url:
            self.og_url = a.get("content", "").strip()
        elif tag == "base" and not self.base:
            self.base = a.get("href", "").strip()
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"].strip())
        if tag in VOID:
            if tag in BLOCK:
                self._add("\n")
            return
        self.open.append(tag)
        if tag in CHROME:
            self.skip += 1
        if tag == "title" and not self.title:
            self.in_title = True
        if tag == "h1" and not self.heading:
            self.in_heading = True
        names = [n for n, hit in (("main", tag == "main"), ("article", tag == "article"), ("role", a.get("role") == "main"), ("content", "content" in a.get("class", ""))) if hit]
        for name in names:
            if name not in self.seen and not self.skip:
                self.seen.add(name)
                self.parts[name] = []
                self.inside.append((len(self.open), name))
        if tag in BLOCK:
            self._add("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        if tag in BLOCK:
            self._add("\n")
        while self.open:
            last = self.open.pop()
            self.inside = [(d, n) for d, n in self.inside if d <= len(self.open)]
            if last in CHROME:
                self.skip = max(0, self.skip - 1)
            if last == "title":
                self.in_title = False
            if last == "h1":
                self.in_heading = False
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            if self.in_heading:
                self.heading += data
            self._add(data)

    def _add(self, data: str) -> None:
        if not self.skip:
            self.parts["body"].append(data)
            for _, name in self.inside:
                self.parts[name].append(data)


def _tidy(parts: list[str]) -> str:
    lines = [" ".join(x.split()) for x in "".join(parts).split("\n")]
    return "\n".join(x for x in lines if x)


def parse_page(page: str | None, url: str = "") -> tuple[str, str, str | None, list[str]]:
    """(main text, title, declared canonical URL, links) of a page.

    The longest of main, article, role=main, class content and body is the text; once one has more than 2 000 characters
    no wider one is looked at. Malformed markup gives what can be read.
    """
    tree = _Tree()
    try:
        tree.feed(page or "")
        tree.close()
    except (AssertionError, ValueError):
        pass
    best = ""
    for name in ("main", "article", "role", "content", "body"):
        text = _tidy(tree.parts.get(name, []))
        if len(text) > len(best):
            best = text
        if len(best) > ENOUGH:
            break
    base = urljoin(url, tree.base) if tree.base else url
    links: dict[str, None] = {}
    for href in tree.links:
        if not href or href.lower().startswith(("#", "mailto:", "javascript:", "data:", "tel:")):
            continue
        try:
            whole = urljoin(base, href)
            if urlsplit(whole).hostname:
                links[whole] = None
        except ValueError:
            continue
    return best, " ".join((tree.title or tree.heading).split()), tree.canonical or tree.og_url or None, list(links)


def html_pages(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``(key, url, text, title, declared, links)`` of HTML pages; one Arrow pass."""
    schema = f"`{key}` {pages.schema[key].dataType.simpleString()}, url string, text string, title string, declared string, links array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse_page(h, u or "") for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [pa.array([g[k] for g in got], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, pa.array([g[3] for g in got], pa.list_(pa.string()))], names=[key, "url", "text", "title", "declared", "links"])

    return pages.select(key, url, html).mapInArrow(run, schema)


def page_documents(parsed: DataFrame, least: int = 200, honour: str = "in_scope") -> DataFrame:
    """Parsed pages as documents: long enough, canonical as declared where ``honour`` (never, in_scope, always) allows it."""
    from corvane.functions.urls import same_host

    declared = F.col("declared")
    ok = {"never": F.lit(False), "always": declared.isNotNull(), "in_scope": declared.isNotNull() & same_host(declared, F.col("url"))}[honour]
    canonical = canonical_news(F.when(ok, declared).otherwise(F.col("url")))
    return parsed.where(F.length("text") >= least).withColumn("canonical_url", canonical).withColumn("suffix", sha1_suffix(F.col("canonical_url")))


def links_of(parsed: DataFrame, key: str) -> DataFrame:
    """``(key, position, link)`` in order of first appearance."""
    return parsed.select(key, F.posexplode("links").alias("position", "link"))


class _Flat(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "svg", "noscript"):
            self.skip += 1
        elif tag in ("td", "th"):
            self.parts.append(" ")
        elif tag in BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "svg", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCK and tag not in ("td", "th"):
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def flat_text(page: str) -> str:
    """All text of a documentation page, one block a line, at most one blank line in a row."""
    p = _Flat()
    p.feed(page)
    lines = "\n".join(" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def documentation_pages(bundles: DataFrame) -> DataFrame:
    """``(slug, framework, path, text, title)`` from (slug, body) rows whose body is a JSON object of path to HTML."""
    rows = bundles.select("slug", F.explode(F.from_json("body", "map<string,string>")).alias("path", "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = b.column(2).to_pylist()
            texts = [flat_text(h or "") for h in pages]
            titles = [parse_page(h)[1] or t.split("\n")[0][:200] for h, t in zip(pages, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(titles, pa.string())], names=["slug", "path", "text", "title"])

    out = rows.mapInArrow(run, "slug string, path string, text string, title string").where("text <> ''")
    return out.withColumn("framework", F.split_part("slug", F.lit("~"), F.lit(1)))


def markdown_documents(blobs: DataFrame) -> DataFrame:
    """``(path, text)`` of (path, content) rows that aren't empty."""
    return blobs.select("path", F.trim(F.decode("content", "UTF-8")).alias("text")).where("text <> ''")


def feed_documents(entries: DataFrame, most: int = 50, least: int = 200) -> DataFrame:
    """The newest entries of each feed with an inline body that is long enough: (feed, position, link, title, body, published) in."""
    at = Window.partitionBy("feed").orderBy(F.col("published").desc_nulls_last(), "position")
    rows = entries.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= most).withColumn("text", clean_fragment(F.col("body"))).where(F.length("text") >= least)
    return rows.withColumn("canonical_url", canonical_news(F.col("link"))).withColumn("suffix", sha1_suffix(F.col("canonical_url"))).drop("_n", "body")


def harvested_records(body: DataFrame) -> DataFrame:
    """``(suffix, deleted, title, abstract, authors, categories, primary_category, datestamp)`` of OAI records, tombstones included."""
    entry = F.explode(F.regexp_extract_all("body", F.lit(r"(?s)(<record>.*?</record>)"), 1)).alias("r")
    one = lambda name: F.trim(F.regexp_replace(F.regexp_extract("r", rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1), r"\s+", " "))
    rows = body.select(entry)
    authors = F.transform(
        F.regexp_extract_all("r", F.lit(r"(?s)<author>(.*?)</author>"), 1),
        lambda a: F.trim(F.regexp_replace(F.concat_ws(" ", *[F.nullif(F.regexp_extract(a, rf"<{t}>(.*?)</{t}>", 1), F.lit("")) for t in ("forenames", "keyname", "suffix")]), r"\s+", " ")),
    )
    return rows.select(
        F.regexp_replace(one("identifier"), r"^.*:", "").alias("suffix"), F.regexp_like("r", F.lit(r"<header[^>]*status=[\"']deleted[\"']")).alias("deleted"), unescaped(one("title")).alias("title"),
        unescaped(one("abstract")).alias("abstract"), authors.alias("authors"), one("categories").alias("categories"), F.split_part(one("categories"), F.lit(" "), F.lit(1)).alias("primary_category"), one("datestamp").alias("datestamp"),
    )


def unescaped(c: Column) -> Column:
    """The five entities of XML decoded."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def story_rows(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Stories of a mirror table within [start, end) epoch seconds; dead and deleted ones are left out. All conditions reach the scan."""
    kept = rows.where(F.col("type").isin("story", "1") & (F.coalesce("dead", F.lit(0)) == 0) & (F.coalesce("deleted", F.lit(0)) == 0) & (F.col("time") >= start) & (F.col("time") < end))
    return story_documents(kept)


def story_documents(rows: DataFrame) -> DataFrame:
    """Stories (id, title, text, url, by, score, descendants, time) in the shape in which they are stored."""
    title, text = clean_title(F.col("title")), F.coalesce(clean_fragment(F.col("text")), F.lit(""))
    return rows.select(
        F.col("id").cast("string").alias("suffix"), title.alias("title"), text.alias("story_text"), F.nullif("url", F.lit("")).alias("target_url"), F.coalesce("by", F.lit("")).alias("author"),
        F.coalesce("score", F.lit(0)).alias("points"), F.coalesce("descendants", F.lit(0)).alias("num_comments"), F.timestamp_seconds("time").alias("created_at"),
        text_hash(F.concat(title, F.lit("\n\n"), text)).alias("text_hash"),
    )


def paired_articles(lines: DataFrame) -> DataFrame:
    """Articles from a dump whose lines alternate between an action and a document.

    ``lines`` is (file, no, value) with line numbers from 0 within each file. The document's own id wins over the action's;
    only namespace 0 and texts that aren't empty count.
    """
    action = lines.where("no % 2 = 0").select("file", F.floor(F.col("no") / 2).alias("pair"), F.get_json_object("value", "$.index._id").alias("action_id"))
    doc = "page_id bigint, namespace int, title string, text string, timestamp string, incoming_links bigint, opening_text string"
    body = lines.where("no % 2 = 1").select("file", F.floor(F.col("no") / 2).alias("pair"), F.from_json("value", doc).alias("d"))
    rows = body.join(action, ["file", "pair"]).where("d.namespace = 0 AND coalesce(trim(d.text), '') <> ''")
    return rows.select(F.coalesce(F.col("d.page_id").cast("string"), "action_id").alias("suffix"), "d.title", "d.text", F.to_timestamp("d.timestamp").alias("revision_ts"), F.coalesce("d.incoming_links", F.lit(0)).alias("incoming_links"), "d.opening_text")


def archive_responses(files: DataFrame) -> DataFrame:
    """``(path, url, date, html)`` of the HTML responses of WARC files (path, content); whole files, one Arrow pass, gzip members included."""

    def records(data: bytes) -> Iterator[tuple[str, str, str]]:
        import gzip

        if data[:2] == b"\x1f\x8b":
            data = gzip.decompress(data)
        at = 0
        while (at := data.find(b"WARC/", at)) >= 0:
            head_end = data.find(b"\r\n\r\n", at)
            if head_end < 0:
                return
            head = dict(line.split(": ", 1) for line in data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
            head = {k.lower(): v for k, v in head.items()}
            size = int(head.get("content-length", "0"))
            body = data[head_end + 4 : head_end + 4 + size]
            at = head_end + 4 + size
            if head.get("warc-type") == "response":
                http, _, page = body.partition(b"\r\n\r\n")
                if b"text/html" in http.lower():
                    yield head.get("warc-target-uri", ""), head.get("warc-date", ""), page.decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = list(records(content or b""))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(got), pa.string()), *[pa.array([g[k] for g in got], pa.string()) for k in range(3)]], names=["path", "url", "date", "html"])

    return files.select("path", "content").mapInArrow(run, "path string, url string, date string, html string")


def plain(text: str) -> str:
    """Character references of a string decoded."""
    return entities.unescape(text)
