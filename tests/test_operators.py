import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from corvane.functions import dates, text, urls
from corvane.operators import dedup, evaluate, filters, ledger, operations, planning, search


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([values], schema).select(column(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("a​b﻿c\U000e0041", "abc"), ("\ttab\nline\ré中文", "\ttab\nline\ré中文"), ("", "")],
)
def test_sanitize(spark, raw, expected):
    assert one(spark, text.sanitize, raw) == expected


def test_blank_and_hash(spark):
    assert one(spark, text.is_blank, "​  \n") is True
    assert one(spark, text.is_blank, None) is True
    assert one(spark, text.text_hash, " A  b\n") == one(spark, text.text_hash, "a b")


def test_readme_and_fragment(spark):
    md = "# Title\n![b](x) see [docs](http://d)\n```\ncode\n```\n<b>bold</b> *x*"
    assert one(spark, text.clean_readme, md) == "Title\n see docs\n \n bold x"
    assert one(spark, text.clean_fragment, "<p>a  &gt; b<p>c <i>d</i>") == "a > b\n\nc d"


@pytest.mark.parametrize(
    ("raw", "news", "crawl"),
    [
        ("HTTPS://Ex.example/Path/?utm_source=x&b=2&a=1#frag", "https://ex.example/Path?b=2&a=1", "https://ex.example/Path/?a=1&b=2"),
        ("http://user@ex.example:80", "http://user@ex.example:80/", "http://ex.example/"),
        ("https://ex.example:8443/?q=&ref=1", "https://ex.example:8443/", "https://ex.example:8443/?q="),
    ],
)
def test_canonical_urls(spark, raw, news, crawl):
    assert one(spark, urls.canonical_news, raw) == news
    assert one(spark, urls.canonical_crawl, raw) == crawl
    assert one(spark, urls.canonical_crawl, crawl) == crawl  # nothing more to do


def test_scope(spark):
    scope = urls.Scope(path_prefix="/posts/", include=("post",), exclude=(r"\.png$",))
    reason = lambda u: one(spark, lambda a, b: scope.reason(a, b), u, "https://www.h.example/")
    assert [reason(u) for u in ("ftp://h.example/", "https://x.example/posts/a", "https://h.example/a", "https://h.example/posts/a.png", "https://h.example/posts/a")] == ["scheme", "host", "prefix", "exclude", ""]
    assert one(spark, urls.path_suffix, "https://h.example/") == "index"
    assert len(one(spark, urls.path_suffix, "https://h.example/" + "a" * 300)) == 177


def test_dates(spark):
    now = F.lit("2026-07-22 12:00:00").cast("timestamp")
    clamp = lambda s: one(spark, lambda c: dates.clamp_date(dates.parse_iso(c), now).cast("string"), s)
    assert clamp("1990-01-01T00:00:00Z") == "1990-01-01 00:00:00"
    assert clamp("1989-12-31T23:59:59Z") is None and clamp("2026-07-25") is None and clamp("rubbish") is None
    assert clamp("2026-07-24T12:00:00+00:00") == "2026-07-24 12:00:00"


def test_exact_duplicates(spark, rows):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, None), (6, "z")], "id bigint, digest string")
    own = spark.createDataFrame([(9, "y", "deleted", 1), (8, "z", "ok", 2), (7, "z", "ok", 3)], "id bigint, digest string, status string, created_at int")
    got = dedup.exact_duplicates(df, "digest", "id", "id", own).select("id", "duplicate_of")
    assert rows(got) == [(1, None), (2, None), (3, 1), (4, None), (5, None), (6, 8)]
    assert rows(dedup.keep_first(df.where("digest IS NOT NULL"), F.col("digest"), "id", 1).select("id")) == [(1,), (2,), (6,)]


def test_greedy_is_not_a_component(spark, rows):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (5, 7), (6, 7)], "earlier bigint, later bigint")
    assert rows(dedup.greedy_duplicates(edges)) == [(2, 1), (4, 3), (6, 5), (7, 5)]
    assert dedup.greedy_duplicates(edges.limit(0)).count() == 0


def test_minhash_bands(spark, rows):
    base = " ".join(f"word{k}" for k in range(120))
    df = spark.createDataFrame([(1, base), (2, base + " end"), (3, " ".join(f"other{k}" for k in range(120))), (4, "too short"), (5, None)], "id bigint, text string")
    assert rows(dedup.band_pairs(dedup.signature_bands(df, "id", "text"), "id", "id")) == [(1, 2)]


def test_filters(spark):
    good = "The people of the town have met to talk and they will be with us. " * 8
    assert one(spark, filters.quality_reason, good) == ""
    assert one(spark, filters.quality_reason, "short text") == "few words"
    assert one(spark, filters.quality_reason, "# " * 100) == "word length"
    assert one(spark, lambda c: filters.language_allowed(c, ("en",)), "EN-us") is True
    assert one(spark, lambda c: filters.language_allowed(c, ("en",)), None) is True
    assert one(spark, filters.c4_reason, "function() { }") == "braces"
    assert one(spark, filters.fineweb_reason, "menu\nhome\nabout") == "line ends"
    df = spark.createDataFrame([(1, "a b a b a b a b\nx\nx\nx"), (2, good.replace(". ", "")[:60]), (3, None)], "id int, text string")
    got = {r["id"]: r for r in filters.repetition(df, "id", "text").collect()}
    assert got[1]["repetitive"] and math.isclose(got[1]["duplicate_lines"], 0.5) and not got[3]["repetitive"]


def test_bm25_prefers_the_matching_text(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green pear tart"), (3, "apple apple apple"), (4, None)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "Apple"), (2, "nothing here")], "query_id bigint, query string")
    assert [r["doc_id"] for r in search.top_k(search.bm25(docs, asked), 5).orderBy("rank").collect()] == [3, 1]
    got, info = search.search(docs, asked, "hybrid", 1)
    assert info == {"mode": "lexical", "degraded": True} and got.count() == 1
    with pytest.raises(ValueError):
        search.search(docs, asked, "dense")


def test_dense_against_brute_force(spark, small):
    import numpy as np

    v = spark.read.parquet(f"{small}/embeddings.parquet")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pdf = v.toPandas().sort_values("vec_id")
    m = np.array(pdf.embedding.tolist())
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in search.dense_top_k(v, q, 5, block=3).collect()}
    for qid in pdf.vec_id[pdf.vec_id % 50 == 0]:
        s = m @ m[list(pdf.vec_id).index(qid)]
        assert [got[qid, k] for k in range(1, 6)] == [int(pdf.vec_id.iloc[i]) for i in np.argsort(-s, kind="stable")[:5]]
    exact = {(a, b) for (a, _), b in got.items()}
    found = {(r["query_id"], r["doc_id"]) for r in search.ClusterIndex.build(v, clusters=32).search(q, 5, 24).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_index_recall_with_defaults(spark):
    from corvane.queries.retrieval import index_recall

    got = index_recall(spark, "/root/testdata/sf0.1").first()
    assert got["wanted"] == 400 and got["recall"] >= 0.9


def test_fusion_filters_and_rerank(spark, rows):
    legs = [spark.createDataFrame(x, "query_id int, doc_id int, rank int") for x in ([(1, 1, 1), (1, 2, 2)], [(1, 2, 1), (1, 3, 2)])]
    assert [r["doc_id"] for r in search.reciprocal_rank_fusion(legs, 3).orderBy("rank").collect()] == [2, 1, 3]
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, stars int")
    assert rows(df.where(search.payload_filter("repos", min_stars=10, outlet="ignored")).select("id")) == [(3,)]


def test_metrics(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id int, doc_id int, rank int")
    judged = spark.createDataFrame([(1, 11, 3), (1, 99, 1)], "query_id int, doc_id int, grade int")
    got = {r["query_id"]: r.asDict() for r in evaluate.metrics(asked, ranked, judged, 3).collect()}
    assert math.isclose(got[1]["ndcg"], (3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert (got[1]["mrr"], got[1]["recall"], got[1]["hit"]) == (0.5, 0.5, 1.0) and math.isclose(got[1]["precision"], 1 / 3)
    assert set(got[2].values()) == {2, 0.0}
    assert evaluate.metrics(asked, ranked, judged, 0).first()["ndcg"] == 0.0


def test_ledger_rules(spark, rows):
    prior = spark.createDataFrame([("a", "h", "m", "searchable"), ("b", "h", "m", "searchable"), ("c", "h", "m", "duplicate"), ("d", "h", "m", "staged")], "id string, text_hash string, metadata_hash string, status string")
    new = spark.createDataFrame([("a", "h", "m", "staged"), ("b", "h", "m2", "staged"), ("c", "h", "m", "duplicate"), ("d", "h", "m", "staged"), ("e", None, None, "empty"), ("f", "x", "m", "deleted")], "id string, text_hash string, metadata_hash string, status string")
    assert rows(ledger.stage_actions(new, prior).select("id", "action")) == [("a", "skip"), ("b", "write"), ("c", "skip"), ("d", "write"), ("e", "ledger"), ("f", "ledger")]


def test_merge_is_idempotent_and_versioned(spark, tmp_path, rows):
    empty = spark.createDataFrame([], "id string, url string, title string, text_hash string, metadata_hash string, status string, created_at timestamp, updated_at timestamp, embedded_model string, indexed_at timestamp")
    batch = spark.createDataFrame([("a", "u", "t", "h", "m", "staged"), ("b", "u", None, None, "m", "empty")], "id string, url string, title string, text_hash string, metadata_hash string, status string")
    now = F.lit("2024-01-01").cast("timestamp")
    table = ledger.VersionedTable(spark, f"file://{tmp_path}/ledger")
    assert table.read() is None
    table.commit(ledger.merge_ledger(empty, batch, now).drop("changed"))
    first = rows(table.read())
    again = ledger.merge_ledger(table.read(), batch, F.lit("2025-01-01").cast("timestamp"))
    assert again.where("changed").count() == 0
    version = table.commit(again.drop("changed"))
    assert rows(table.read()) == first and version.startswith("v2-")


def test_tombstones_are_guarded(spark, rows):
    prior = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t"), ("d", "u"), ("e", "v")], "id string, source string").withColumn("status", F.lit("searchable"))
    present = spark.createDataFrame([("a", "s", False), ("x", "t", True), (None, "u", False)], "id string, source string, truncated boolean")
    gone = lambda **k: [r[0] for r in rows(ledger.tombstone_missing(prior, present, **k).where("tombstoned").select("id"))]
    assert gone() == ["b"]
    assert gone(refuse_empty=False) == ["b", "d"]


def test_planning(spark, rows):
    assert planning.split_range(0, 10, lambda a, b: b - a, 3) == [(0, 2), (2, 5), (5, 7), (7, 10)]
    after = datetime(2024, 3, 30, 23, 0, tzinfo=timezone.utc)
    assert planning.next_fire({"cron": "30 2 * * *", "tz": "Europe/Berlin"}, after).isoformat() == "2024-04-01T02:30:00+02:00"  # 31 March has no 2:30
    assert planning.next_fire({"cron": "*/15 * * * 1-5"}, after).isoformat() == "2024-04-01T00:00:00+00:00"
    for bad in ("* * * *", "61 * * * *", "*/0 * * * *", "a * * * *"):
        with pytest.raises(ValueError):
            planning.parse_cron(bad)
    assert planning.static_unit(spark, "s", "k", "a=1, b=2").first()["payload"] == {"a": "1", "b": "2"}
    hours = planning.calendar_keys(spark, "2024-01-02 00:00:00", 1, "yyyy-MM-dd-{h}", "hour", True)
    assert hours.count() == 24 and ("2024-01-01-7",) in rows(hours.select("unit_key"))
    ev = spark.createDataFrame([(1, "x", "s", "scheduler"), (2, "x", "s", None), (3, "x", "t", None)], "seq int, event string, source string, origin string")
    assert planning.match_trigger(ev, 0, "x").first()["seq"] == 2 and planning.match_trigger(ev, 2, "x", "s").count() == 0
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert rows(planning.crawl(seeds, links, 2, 3)) == [("a", 0), ("b", 1), ("c", 1)]


def test_garbage_skips_what_does_not_fit(spark):
    files = spark.createDataFrame([("a", 1, 5), ("b", 2, 50), ("c", 3, 5), ("d", 4, 5)], "path string, m int, size int").select("path", F.timestamp_seconds("m").alias("modified"), "size")
    kept = spark.createDataFrame([("d",)], "path string")
    got = operations.collect_garbage(files, kept, F.lit("2024-01-01").cast("timestamp"), 1, 5, 12)
    assert [r["path"] for r in got.orderBy("path").collect()] == ["a", "c"]
