"""The main body of a page, told from menus, notices, teasers and footers by a minimum cut.

Lines of a page are the nodes of a graph. A linear classifier over each line and its place gives the cost of calling it
boilerplate and the cost of calling it content; these are the capacities to the two terminals. Lines that stand next to
each other, or one apart, are joined by smoothness edges, stronger where they look alike or where a title stands over a
paragraph. The minimum cut of that graph is the labelling with the least total cost. Two statistics come from the whole
collection, each within its site: how many different pages, and what share of the site's, hold a line (by its letters), and
how often the line after it looks like a title, which marks the headings of teaser boxes. A repeated line has a high cost
as content; the cut decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.sitelines import letters_of
from corvane.llm.words import FUNCTION_OF, WORD
from corvane.session import WHITE, Scratch, at_most, broadcast_if_small

CLOSERS = "\"'”’»)]"
SENTENCE_END = re.compile(r"[.!?][\"'”’»)\]]*(?:\s|$)")
BULLET = re.compile(r"^\s*(?:[-*•–»]|\d{1,3}[.)])\s+")
ITEMS = re.compile(r"\s*[·|›»/•]\s*|\s{2,}|\s[-–—>]\s")
PRICE = re.compile(r"(?:^|\s)[€$£]?\d+[.,]\d\d\s*(?:[€$£]|EUR|USD|GBP)?\s*$")
OPENING = 12
#: Every character that WHITE matches; their number bounds that of the words of a line.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
NO_LETTER = re.compile(r"[\W\d_]+")
CELL = re.compile(r"\s*\|\s*|\t+")
TITLE_SQL = r"[.!?:;][\"'”’»)\]]*$|[”»)]$"


@dataclass(frozen=True)
class Weights:
    """Costs in nats. Positive terms speak for content."""

    paragraph: float = 3.0
    per_sentence: float = 0.6
    repeated: float = -6.0
    cut_off: float = -6.0
    menu: float = -4.0
    price: float = -4.0
    mark: float = -4.0
    boxed: float = -3.0
    headline: float = 2.0
    title: float = -0.35
    item: float = -0.2
    row: float = 0.3
    other: float = -0.3
    beside: float = 0.9
    across_blank: float = 0.7
    alike: float = 0.6
    heads: float = 1.0
    apart: float = 0.25
    wall: float = -2.5
    past_wall: float = 0.3
    box_share: float = 0.6
    pages: int = 3
    share: float = 0.001


def cut_labels(content: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Minimum cut. Nodes whose own cost outweighs all their edges are decided first and passed on to their neighbours,
    which leaves the minimum as it is; the flow then runs over what is undecided."""
    n = len(content)
    cost = content.tolist()
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    pull = [0.0] * n
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
        pull[a] += w
        pull[b] += w
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is not None or abs(cost[i]) <= pull[i]:
            continue
        label[i] = cost[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                pull[j] -= w
                cost[j] += w if label[i] else -w
                todo.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        at = {i: k for k, i in enumerate(open_)}
        inside = max_flow_labels(np.array([cost[i] for i in open_]), [(at[a], at[b], w) for a, b, w in edges if a in at and b in at])
        for i, x in zip(open_, inside.tolist(), strict=True):
            label[i] = x
    return np.array(label, bool)


def max_flow_labels(content: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Minimum cut by Dinic's algorithm. ``content[i]`` > 0 is capacity from the source, < 0 to the sink; True = source side."""
    n = len(content)
    source, sink = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, c in enumerate(content.tolist()):
        if c > 0:
            link(source, i, c, 0.0)
        elif c < 0:
            link(i, sink, -c, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for u in queue:
            for e in out[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([level[i] >= 0 for i in range(n)], bool)
        at = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                del path[k:]
                u = to[path[-1]] if path else source
                continue
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(out[u]):
                path.append(out[u][at[u]])
                u = to[path[-1]]
            elif path:
                e = path.pop()
                u = to[e ^ 1]
                at[u] += 1
            else:
                break


def kind_of(line: str) -> tuple[str, int]:
    """(kind, sentences) of a line by its own looks: paragraph, cut, menu, price, mark, row, item, title or other."""
    s = line.strip()
    words = WORD.findall(s)
    n = len(words)
    if not n:
        return "other", 0
    bare = s.rstrip(CLOSERS)
    if bare.endswith(("…", "...")):
        return "cut", 0
    if "©" in s:
        return "mark", 0
    ends = bare[-1:] in (".", "!", "?", ":", ";") or s[-1] in "”»)"
    sentences = len(SENTENCE_END.findall(s)) if ends or n > 24 else 0
    if BULLET.match(s):
        return ("paragraph", sentences) if ends and sentences and n >= 10 else ("item", 0)
    parts = [x for x in ITEMS.split(s) if x]
    if len(parts) >= 3 and not ends:
        if len(CELL.split(s)) >= 2 and any(x.strip().isdigit() for x in parts):
            return "row", 0
        if sum(len(x.split()) for x in parts) / len(parts) <= 6:
            return "menu", 0
    if len(parts) >= 3 and "›" in s:
        return "menu", 0
    if s.count(",") >= 4 and s.count(",") >= 0.6 * n - 2:
        return "menu", 0
    if PRICE.search(s):
        return "price", 0
    if ends and n >= 6 and sum(w in FUNCTION_OF for w in WORD.findall(s.lower())) >= 0.12 * n:
        return "paragraph", max(1, sentences)
    if not ends and n <= 24:
        return "title", 0
    return ("paragraph", sentences) if sentences >= 2 else ("other", 0)


def letters(line: str) -> str:
    """The same as ``letters_of`` in SQL."""
    joined = NO_LETTER.sub("", line.lower())
    return joined if not joined or joined.isalpha() else "".join(ch for ch in joined if ch.isalpha())


def covered(tokens: list[str], known: Callable[[list[int]], list[bool]], hashes: Callable[[int, int], int], longest: int) -> bool:
    """Whether a line is nothing but repeated lines put one after the other, as footers often are (longest match first)."""
    at = 0
    while at < len(tokens):
        ends = list(range(min(len(tokens), at + longest), at, -1))
        hit = known([hashes(at, e) for e in ends])
        if True not in hit:
            return False
        at = ends[hit.index(True)]
    return True


def label_page(text: str, often_at: set[int], heads: set[int], w: Weights) -> list[int]:
    """Numbers of the lines of the main body. ``often_at``: numbers of repeated lines; ``heads``: those that head a box."""
    lines = text.split("\n")
    nodes = [k for k, x in enumerate(lines) if WORD.search(x)]
    if not nodes:
        return []
    often = [k + 1 in often_at for k in nodes]
    kinds = [("often", 0) if o and k + 1 not in heads else kind_of(lines[k]) for k, o in zip(nodes, often, strict=True)]
    article = [kind == "paragraph" and not o for (kind, _), o in zip(kinds, often, strict=True)]
    if not any(article):
        return []
    cost = np.zeros(len(nodes))
    box = ""  # '' outside a box, else the kind of its entries, '?' before the first
    body_seen, headline_seen = False, False
    for i, (k, (kind, sentences)) in enumerate(zip(nodes, kinds, strict=True)):
        if often[i]:
            cost[i] = w.repeated
            box = "?" if k + 1 in heads and kind != "menu" else ""
            continue
        before_body = i + 1 < len(nodes) and article[i + 1]
        short = len(WORD.findall(lines[k])) <= 3
        if box and (kind in ("paragraph", "row") or box in ("title", "item") and kind in ("title", "item") and kind != box or kind == "title" and short and before_body):
            box = ""
        if kind == "paragraph":
            cost[i] = w.paragraph + w.per_sentence * sentences
            body_seen = True
        elif kind in ("cut", "menu", "price", "mark"):
            cost[i] = {"cut": w.cut_off, "menu": w.menu, "price": w.price, "mark": w.mark}[kind]
            if kind == "cut" and box == "?":
                box = "title"
        elif kind == "row":
            cost[i] = w.row
        elif box:
            box = kind if kind in ("title", "item") else box
            last = kind == "title" and before_body and not body_seen and not headline_seen
            cost[i] = w.headline if last else w.boxed
            headline_seen |= last
        elif kind == "title" and not short and not body_seen and not headline_seen:
            cost[i], headline_seen = w.headline, True
        else:
            cost[i] = w.title if kind == "title" else w.item if kind == "item" else w.other
    edges = []
    for i in range(len(nodes) - 1):
        a, b = kinds[i][0], kinds[i + 1][0]
        weight = w.beside if nodes[i + 1] - nodes[i] == 1 else w.across_blank
        if cost[i] <= w.wall or cost[i + 1] <= w.wall:
            weight *= w.past_wall  # what is surely no content says little about its neighbours
        elif a == b:
            weight += w.alike
        if a == "title" and b == "paragraph" and cost[i] > w.wall and cost[i + 1] > w.wall:
            weight += w.heads
        edges.append((i, i + 1, weight))
        if i + 2 < len(nodes):
            edges.append((i, i + 2, w.apart * (w.past_wall if min(cost[i], cost[i + 1], cost[i + 2]) <= w.wall else 1)))
    inside = cut_labels(cost, edges)
    return [nodes[int(i)] + 1 for i in np.flatnonzero(inside)]


def tokens_of(line: Column) -> Column:
    """Letters of the white-space separated tokens that have any."""
    return F.filter(F.transform(F.split(line, WHITE), letters_of), lambda x: F.length(x) > 0)


def _lines(df: DataFrame, text: str, site: Column) -> DataFrame:
    """``(site, page, node, opening, size, words, after, titled)`` of the lines with letters; titled: whether the next line looks like a title."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda line: F.struct(letters_of(line).alias("letters"), F.trim(line).alias("line")))
    lines = F.transform(F.filter(lines, lambda x: F.length(x["letters"]) >= 2), lambda x: F.struct(F.xxhash64("site", x["letters"]).alias("node"), F.xxhash64(F.substring(x["letters"], 1, OPENING)).alias("opening"), F.least(F.length(x["letters"]), F.lit(OPENING)).alias("size"), (F.length(x["line"]) - F.length(F.translate(x["line"], SPACES, "")) + 1).alias("words"), x["line"].alias("line")))
    rows = df.where(F.col(text).isNotNull()).select(site.alias("site"), text).select("site", F.xxhash64(text).alias("page"), lines.alias("x")).select("site", "page", F.posexplode("x").alias("at", "l"), "x")
    after = F.get("x", F.col("at") + 1)
    line = after["line"]
    titled = (~line.rlike(TITLE_SQL) | line.rlike("…")) & F.size(F.split(line, r"\s+")).between(4, 22) & ~line.rlike("[·|›]")
    return rows.select("site", "page", F.col("l.node").alias("node"), F.col("l.opening").alias("opening"), F.col("l.size").alias("size"), F.col("l.words").alias("words"), after["node"].alias("after"), titled.alias("titled"))


def line_statistics(df: DataFrame, text: str, site: Column, w: Weights, scratch: Scratch, small: int) -> DataFrame:
    """``(node, opening, size, words, head)`` of the lines that enough different texts of a site hold, by number and by share
    of the site's texts; head marks those that titles usually follow.

    Equal pages count once; lines after which another repeated line comes say nothing about heads. All counts are
    combined before they are shuffled.
    """
    rows = scratch.keep(_lines(df, text, site), "all")
    sizes = rows.groupBy("site").agg(F.count_distinct("page").alias("whole"))
    counted = rows.groupBy("site", "node").agg(F.count_distinct("page").alias("pages"), F.min("opening").alias("opening"), F.min("size").alias("size"), F.max("words").alias("words")).where(F.col("pages") >= w.pages)
    counted = counted.join(broadcast_if_small(sizes, small), "site").where(F.col("pages") >= w.share * F.col("whole"))
    often = scratch.keep(counted.select("node", "opening", "size", "words"), "often")
    held = rows.where("after IS NOT NULL").join(broadcast_if_small(often.select("node"), small), "node")
    first = held.join(broadcast_if_small(often.select(F.col("node").alias("after")), small), "after", "left_anti")
    heads = first.groupBy("node").agg(F.avg(F.col("titled").cast("double")).alias("share"), F.count("*").alias("times")).where((F.col("share") >= w.box_share) & (F.col("times") >= w.pages))
    out = scratch.keep(often.join(heads.select("node", F.lit(True).alias("head")), "node", "left").select("node", "opening", "size", "words", F.coalesce("head", F.lit(False)).alias("head")), "lines")
    scratch.drop(rows)
    return out


def main_content(df: DataFrame, key: str = "page_id", text: str = "text", weights: Weights | None = None, small: int = 1_000_000, source: str | None = None) -> DataFrame:
    """``(key, line_no)`` of the lines of each page's main body; line numbers count all lines from 1.

    Null and empty texts, and pages without a body, give no rows; a null key stays null; repeated pages each give their
    rows; an empty table gives none; other columns are not read. ``source`` names the column of the site, within which lines
    are counted; without it all pages are one site, and pages with a null there are one more. The hashes of repeated lines travel to the executors as
    one sorted array while they are at most ``small``; beyond, pages meet them in joins that give the same result.
    """
    w = weights or Weights()
    spark = df.sparkSession
    scratch = Scratch(spark, "maincontent")
    site = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
    stats = line_statistics(df, text, site, w, scratch, small)
    longest = max(1, stats.agg(F.max("words")).first()[0] or 0)  # of a repeated line, so none that is joined to others is overlooked
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, line_no int"
    pages = df.where(F.col(text).isNotNull())

    def emit(ids: pa.Array, out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array([x for x, _ in out], pa.int64())), pa.array([n for _, n in out], pa.int32())], names=[key, "line_no"])

    if at_most(stats, small):
        got = stats.toPandas().sort_values("node")  # at most ``small`` rows of 21 bytes
        table = spark.sparkContext.broadcast((got["node"].to_numpy("int64"), got["head"].to_numpy(bool), np.unique(got["opening"].to_numpy("int64")), np.unique(got["size"].to_numpy("int64"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes, head, opening, size = table.value
            known, opens, sizes = dict(zip(nodes.tolist(), head.tolist(), strict=True)), set(opening.tolist()), size.tolist()
            for b in batches:
                out: list[tuple[int, int]] = []
                for i, (t, of) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    often, heads, seed = set(), set(), spark_seed(of)
                    for no, line in enumerate(t.split("\n"), 1):
                        joined = letters(line)
                        if len(joined) < 2:
                            continue
                        is_head = known.get(spark_hash(joined, seed))
                        if is_head is None:
                            if not any(spark_hash(joined[:n]) in opens for n in sizes):
                                continue  # no repeated line begins like this
                            parts = [p for p in map(letters, line.split()) if p]
                            if covered(parts, lambda hs: [h in known for h in hs], lambda a, e, p=parts, seed=seed: spark_hash("".join(p[a:e]), seed), longest):
                                often.add(no)
                            continue
                        often.add(no)
                        if is_head:
                            heads.add(no)
                    out += [(i, no) for no in label_page(t, often, heads, w)]
                yield emit(b.column(0), out)

        return pages.select(key, text, site.alias("site")).mapInArrow(run, schema)

    # every line with the hashes of its prefixes; lines that begin with a repeated line then with those of all their windows
    seat = pages.select(F.xxhash64(site, text).alias("seat"), site.alias("site"), key, text)
    line = seat.select("seat", "site", F.posexplode(F.split(text, "\n")).alias("at", "line")).distinct()
    line = line.select("seat", "site", (F.col("at") + 1).alias("no"), letters_of(F.col("line")).alias("whole"), tokens_of(F.col("line")).alias("t")).where(F.length("whole") >= 2)
    exact = line.select("seat", "no", F.xxhash64("site", "whole").alias("node")).join(stats, "node").select("seat", F.struct("no", F.lit(-1).alias("a"), F.lit(-1).alias("e"), "head").alias("x"))
    ends = F.sequence(F.lit(1), F.least(F.size("t"), F.lit(longest)))
    prefixes = line.select("seat", "site", "no", "t", F.explode(ends).alias("e")).select("seat", "site", "no", "t", F.xxhash64("site", F.array_join(F.slice("t", 1, F.col("e")), "")).alias("node"))
    begun = prefixes.join(stats.select("node"), "node", "left_semi").select("seat", "site", "no", "t").distinct()
    starts = begun.select("seat", "site", "no", "t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("a"))
    windows = starts.select("seat", "site", "no", "t", "a", F.explode(F.sequence(F.lit(1), F.least(F.size("t") - F.col("a") + 1, F.lit(longest)))).alias("n"))
    windows = windows.select("seat", "no", (F.col("a") - 1).alias("a"), (F.col("a") - 1 + F.col("n")).alias("e"), F.xxhash64("site", F.array_join(F.slice("t", F.col("a"), F.col("n")), "")).alias("node"))
    parts = windows.join(stats.select("node"), "node", "left_semi").select("seat", F.struct("no", "a", "e", F.lit(False).alias("head")).alias("x"))
    held = exact.union(parts).groupBy("seat").agg(F.collect_list("x").alias("held"))  # no longer than the page

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (t, got) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                lines = t.split("\n")
                often = {x["no"] for x in got or [] if x["a"] < 0}
                heads = {x["no"] for x in got or [] if x["head"]}
                spans: dict[int, set[tuple[int, int]]] = {}
                for x in got or []:
                    if x["a"] >= 0 and x["no"] not in often:
                        spans.setdefault(x["no"], set()).add((x["a"], x["e"]))
                for no, have in spans.items():
                    parts_of = [p for p in map(letters, lines[no - 1].split()) if p]
                    if covered(parts_of, lambda hs: [h in have for h in hs], lambda a, e: (a, e), longest):
                        often.add(no)
                out += [(i, no) for no in label_page(t, often, heads, w)]
            yield emit(b.column(0), out)

    return seat.join(held, "seat", "left").select(key, text, "held").mapInArrow(run_joined, schema)


def spark_seed(site: str) -> int:
    """Seed with which Spark's xxhash64 of (site, text) goes on after the site."""
    return xxhash.xxh64_intdigest(site.encode(), 42)


def spark_hash(text: str, seed: int = 42) -> int:
    """The value of Spark's xxhash64 for one string, or for one that follows others."""
    h = xxhash.xxh64_intdigest(text.encode(), seed)
    return h - (1 << 64) if h >> 63 else h
