import gzip

import pytest
from pyspark.sql import functions as F

from corvane.operators.ledger import VersionedTable
from corvane.plans import flows, spec, udf
from corvane.sources import catalog, extract, push, readers
from corvane.streaming import streams


def body(spark, text):
    return spark.createDataFrame([(text,)], "body string")


def test_listings(spark, rows):
    assert rows(catalog.url_list(body(spark, "# c\nhttps://A.example/x\n\nhttps://A.example/x\nmailto:x@y\n"), shrink_floor=1)) == [("https://A.example/x", "a.example")]
    with pytest.raises(ValueError, match="fewer than"):
        catalog.url_list(body(spark, "https://a.example/"), shrink_floor=5)
    manifest = catalog.json_manifest(body(spark, '[{"slug":"a~1","mtime":3},{"slug":""},{"x":1}]'), "slug", "mtime", scope_prefix="docs:")
    assert rows(manifest.select("unit_key", "upstream", "id_scope")) == [("a~1", "3", "docs:a~1/")]
    paths = spark.createDataFrame([("crawl/2024/01/05/a.warc.gz",), ("crawl/20240101-b.warc.gz",), ("other",)], "value string")
    assert rows(catalog.path_manifest(paths, ("crawl",), "2024-01-06", min_age=3).select("unit_key")) == [("crawl/20240101-b.warc.gz",)]
    index = '<a href="done.txt">d</a>\n<a href="/x/a-20240101.bz2">a</a>  01-Jan-2024 10:00   123\n<a href="b.txt">b</a>'
    assert rows(catalog.apache_index(body(spark, index), marker="done.txt", date="20240101")) == [("a-20240101.bz2", 123)]
    assert catalog.apache_index(body(spark, index), marker="missing").count() == 0
    items = catalog.search_items(body(spark, '{"items":[{"id":1,"full_name":"o/r","stargazers_count":3,"topics":["t"]},{"id":2}]}'))
    assert rows(items.select("repo_id", "stars")) == [(1, 3)]


def test_pages(spark):
    page = "<html><head><title> T </title><base href='https://h.example/d/'><link rel='canonical' href='https://h.example/c'></head><body><nav>menu</nav><main>short</main><div class='content'><p>the body text</p>tail</div><a href='x'>x</a><a href='mailto:a'>m</a><script>no</script></body>"
    text, title, declared, links = extract.parse_page(page, "https://h.example/")
    assert (title, declared, links) == ("T", "https://h.example/c", ["https://h.example/d/x"])
    assert "menu" not in text and "no" not in text.split() and "tail" in text
    assert extract.parse_page("<p>broken <b>markup") == ("broken markup", "", None, [])
    assert extract.parse_page(None)[0] == ""
    rows = spark.createDataFrame([(1, "https://h.example/", page * 20), (2, "https://h.example/", None)], "id int, url string, html string")
    docs = extract.page_documents(extract.html_pages(rows, "id", "url", "html"), least=10).collect()
    assert [(d["id"], d["canonical_url"]) for d in docs] == [(1, "https://h.example/c")]
    assert extract.flat_text("<h1>A</h1><table><tr><td>x</td><td>y</td></tr></table>") == "A\n\nx y"


def test_harvest_and_dump(spark, rows):
    xml = "<r><record><header status=\"deleted\"><identifier>oai:x:1</identifier><datestamp>2024</datestamp></header></record><record><header><identifier>oai:x:2</identifier></header><title>A &amp;\n B</title><categories>cs.CL cs.AI</categories><authors><author><keyname>K</keyname><forenames>F</forenames></author></authors></record></r>"
    got = extract.harvested_records(body(spark, xml)).orderBy("suffix").collect()
    assert [(r["suffix"], r["deleted"], r["title"], r["primary_category"], r["authors"]) for r in got] == [("1", True, "", "", []), ("2", False, "A & B", "cs.CL", ["F K"])]
    lines = [('{"index":{"_id":"7"}}', 0), ('{"namespace":0,"title":"t","text":"x"}', 1), ('{"index":{"_id":"8"}}', 2), ('{"page_id":9,"namespace":1,"text":"y"}', 3)]
    df = spark.createDataFrame([("f", no, v) for v, no in lines], "file string, no int, value string")
    assert rows(extract.paired_articles(df).select("suffix", "title")) == [("7", "t")]


def test_archive(spark, rows):
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: https://h.example/\r\nWARC-Date: 2024\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(page), page)
    files = spark.createDataFrame([("a", bytearray(gzip.compress(record * 2))), ("b", bytearray(b""))], "path string, content binary")
    assert rows(extract.archive_responses(files).select("url", "html")) == [("https://h.example/", "<p>hi</p>")] * 2


def test_push(spark, rows):
    ok = spark.createDataFrame([("c/00001", None, "t", "body", None, '{"conversation_id":"c","message_range":[0,3]}', None)], push.PUSHED)
    assert push.push(ok).first()["partition"] == "c"
    for fields, why in (('{"message_range":[3,1]}', "range"), ('{"conversation_id":"d"}', "partition")):
        bad = ok.withColumn("fields", F.lit(fields))
        with pytest.raises(ValueError, match=why):
            push.push(bad)
    mixed = ok.union(ok.withColumn("id", F.lit("d/1")).withColumn("fields", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="mixes"):
        push.push(mixed)
    assert rows(push.push(ok.limit(0), "full_set", "c").select("partition", "is_coverage")) == [("c", True)]


def test_readers(spark, tmp_path, rows):
    docs = spark.createDataFrame([("x", "u", "t", "body")], "suffix string, url string, title string, text string")
    readers.staged(docs, "news", "news:").write.parquet(f"{tmp_path}/s")
    assert readers.read_staged(spark, f"{tmp_path}/s", "news").first()["id"] == "news:x"
    (tmp_path / "l.txt").write_text("a\nb\n")
    assert rows(readers.read_numbered_lines(spark, f"{tmp_path}/l.txt").select("no", "value")) == [(0, "a"), (1, "b")]
    ev = spark.sql("SELECT timestamp'2024-01-05' AS ts, 1 AS seq UNION ALL SELECT timestamp'2024-02-05', 2")
    readers.append_journal(ev, f"{tmp_path}/j")
    assert rows(readers.read_journal(spark, f"{tmp_path}/j", "2024-02-01", "2024-03-01").select("seq")) == [(2,)]


def issues(document):
    return {(i.path, i.code) for i in spec.check(document, flows.standard_modules({}))}


def test_flow_checks():
    assert issues(flows.NEWS) == set() and issues(flows.CRAWL) == set()
    assert issues([]) == {("", "invalid_type")}
    bad = {
        "schema": "x", "extra": 1, "flows": {"f": {
            "nodes": {"a": {"kind": "discover", "uses": "root"}, "b": {"kind": "transform", "uses": "dedup.exact", "with": {"q": 1}}, "c": {"kind": "transform", "uses": "filter.length", "with": {"min_chars": "x"}}, "d": {"kind": "bad", "uses": "none"}},
            "edges": [{"from": {"node": "a"}, "to": {"node": "b"}}, {"from": {"node": "b"}, "to": {"node": "c"}}, {"from": {"node": "c"}, "to": {"node": "b"}}, {"from": {"node": "b"}, "to": {"node": "c"}}, {"from": {"node": "z"}, "to": {"node": "b"}}],
        }},
    }
    got = {c for _, c in issues(bad)}
    assert got == {"unsupported_schema", "unknown_field", "required", "unknown_module_parameter", "invalid_value", "unknown_kind", "unknown_module", "port_type_mismatch", "cycle", "duplicate_edge", "unknown_node"}
    assert spec.indexable(flows.NEWS, flows.standard_modules({})) == []


def test_flow_runs(spark, rows):
    docs = spark.createDataFrame([(1, "https://a.example/x?utm_a=1", "t", "same text here"), (2, "https://a.example/y", "t", "same  TEXT here")], "ordinal bigint, url string, title string, text string").withColumn("canonical_url", F.lit(None).cast("string")).withColumn("suffix", F.lit(""))
    got = spec.compose(flows.NEWS, flows.standard_modules({"documents": docs}), "ingest")["stage"].orderBy("ordinal").collect()
    assert got[0]["canonical_url"] == "https://a.example/x" and got[1]["duplicate_of"] == got[0]["suffix"]


def test_custom_modules(spark, rows):
    r = udf.Registry()
    r.create("upper", "transform", "def transform(record, config):\n    if record['t'] is None:\n        return None\n    record['t'] = record['t'].upper() + config['end']\n    return record\n")
    df = spark.createDataFrame([("a",), (None,)], "t string")
    with pytest.raises(ValueError):
        r.apply("upper", df)
    assert r.test("upper", {"t": "x"}, {"end": "!"}) == {"t": "X!"}
    r.approve("upper")
    assert rows(r.apply("upper", df, {"end": "!"})) == [("A!",)]
    r.revoke("upper")
    with pytest.raises(ValueError):
        r.create("upper", "transform", "def transform(record, config):\n    return None")
    for bad in ("import os\ndef transform(record, config):\n    return 1", "def transform(record, config):\n    return ().__class__", "def transform(record, config):\n    return eval('1')", "def f():\n    pass", "def transform(:", "def transform(record, config):\n    return '{0}'.format(record)"):
        assert udf.problems(bad)


def test_streams(spark, tmp_path, rows):
    files = tmp_path / "in"
    base = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 600) AS ts, id AS seq, id % 2 AS user, cast(id AS double) AS value FROM range(12)")
    for k in range(3):
        base.where(f"seq DIV 4 = {k}").coalesce(1).write.mode("append").parquet(str(files))
    stream = lambda: streams.journal_stream(spark, str(files), base.schema)
    streams.run_to_end(streams.windowed_counts(stream(), "ts", ("user",), "1 hour"), f"{tmp_path}/c1", mode="complete", name="hourly")
    assert rows(spark.table("hourly").groupBy().sum("events")) == [(12,)]
    fired = []
    ev = stream().select("seq", F.lit("done").alias("event"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("origin"))
    streams.run_to_end(ev, f"{tmp_path}/c2", batch=streams.trigger_batches(spark, f"{tmp_path}/cursor", "done", "s", fired.append, 5))
    assert all(s > 5 for s in fired) and fired == sorted(fired) and fired
    before = list(fired)
    streams.run_to_end(ev, f"{tmp_path}/c2b", batch=streams.trigger_batches(spark, f"{tmp_path}/cursor", "done", "s", fired.append, 5))
    assert all(s > max(before) for s in fired[len(before) :])  # a restart goes on where it stood
    table = VersionedTable(spark, f"file://{tmp_path}/ledger")
    empty = spark.createDataFrame([], "id string, url string, title string, text_hash string, metadata_hash string, status string, created_at timestamp, updated_at timestamp, embedded_model string, indexed_at timestamp")
    docs = stream().select(F.col("user").cast("string").alias("id"), F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit("h").alias("text_hash"), F.lit("m").alias("metadata_hash"), F.lit("staged").alias("status")).dropDuplicates(["id"])
    streams.run_to_end(docs, f"{tmp_path}/c3", batch=streams.ledger_batches(table, empty, lambda n: F.lit("2024-01-01").cast("timestamp")))
    assert rows(table.read().select("id")) == [("0",), ("1",)]


def test_rolling_bands_of_a_stream(spark, tmp_path, rows):
    text = " ".join(f"word{k}" for k in range(40))
    batch = lambda pairs: spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(pairs)], "id string, text string, ordinal int")
    seen = {}
    look = streams.band_batches(f"{tmp_path}/bands", F.lit("2024-01-02").cast("date"), 7, lambda found, number: seen.__setitem__(number, rows(found)))
    look(batch([("a", text), ("b", "quite other words that share nothing at all with it"), ("c", text + " more")]), 0)
    look(batch([("d", text), ("e", "short")]), 1)
    look(batch([("d", text), ("e", "short")]), 1)  # comes again
    assert seen == {0: [("c", "a")], 1: [("d", "a")]}
    later = streams.band_batches(f"{tmp_path}/bands", F.lit("2024-01-20").cast("date"), 7, lambda found, number: seen.__setitem__(number, rows(found)))
    later(batch([("f", text)]), 2)
    assert seen[2] == []


def test_modules_of_quality_language_and_boilerplate(spark):
    good = "\n".join((
        "The council of the town met in the hall and said that the bridge would be closed until spring.", "Farmers along the river have to move their sheep before the water rises again.",
        "Nobody asked who pays for it, though a teacher with two children raised her hand.", "Later that evening, music came from an open window near the station.",
        "Engineers measured cracks under every arch, took photographs and wrote a long report.", "By Friday morning, most of those present had signed the letter to the minister.",
    ))
    docs = [(1, good, "en"), (2, good.upper(), "en"), (3, good.replace(" ", "  "), "fr"), (4, "{ " + good, None), (5, "word " * 400, None), (6, good + "\nok", "")]
    df = spark.createDataFrame(docs, "ordinal int, text string, lang string")
    m = flows.standard_modules({}, detector=lambda d: d.select("ordinal", F.when(F.col("ordinal") == 4, "nl").alias("detected")))
    run = lambda name, **s: {r["ordinal"]: r["text"] for r in m[name].run(df, s).collect()}
    assert set(run("dedup.boilerplate", repeat_cap=2)) == {1, 2, 4, 5, 6}
    assert set(run("filter.lang", allowed="en, nl")) == {1, 2, 4, 5, 6}
    kept = run("filter.quality")
    assert 1 in kept and 6 in kept and kept[6] == good and not {4, 5} & set(kept)
