"""A history that lasts: order of ids, hot paragraphs, another session, what a delivery reads."""

import pytest

from corvane.llm.history import History, repeats_of_accepted, sign_records
from corvane.llm.sketch import SetSketch
from tests.llm.test_neardup_history import brute_repeats, corpus

SCHEMA = "ingest_id bigint, batch_no int, text string"


def test_ids_that_descend_over_batches(spark):
    rows = [(10_000 - i, min(3, i * 4 // 200), t) for i, t in corpus(seed=5)]
    got = {r["id"] for r in repeats_of_accepted(spark.createDataFrame(rows, SCHEMA), threshold=0.6, accepted_batch=0).collect()}
    assert got == brute_repeats(rows, 0.6) != set()


def test_ids_that_are_strings(spark):
    rows = [(f"{(i * 7919) % 1000:04d}", min(3, i * 4 // 200), t) for i, t in corpus(seed=6)]
    df = spark.createDataFrame(rows, "ingest_id string, batch_no int, text string")
    assert {r["id"] for r in repeats_of_accepted(df, threshold=0.6, accepted_batch=0).collect()} == brute_repeats(rows, 0.6)


@pytest.mark.parametrize("held", ["history", "batch"])
def test_a_paragraph_that_ten_records_hold(spark, held):
    common = " ".join(f"c{k}" for k in range(60))
    notice = "this notice stands at the foot of every single page of the site"
    rows = [(k, 0, common + "\n" + " ".join(f"o{k}x{j}" for j in range(200)) + "\n" + notice) for k in range(10)]
    rows += [(10, 0, common + "\n" + " ".join("abcdefgh") + "\n" + notice), (11, 1, common + "\n" + " ".join("abcdefgx") + "\n" + notice)]
    if held == "batch":
        rows = [(i, 1, t) for i, _, t in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    blind = SetSketch(bands=1, rows=256)  # its one band only finds equal sets
    got = {r["id"] for r in repeats_of_accepted(df, threshold=0.6, accepted_batch=0, sketch=blind).collect()}
    assert got == brute_repeats(rows, 0.6) == {11}


def test_a_hot_notice_makes_no_candidates(spark, tmp_path):
    notice = "this notice stands at the foot of every single page of the site"
    text = lambda k: "\n".join([" ".join(f"w{k}x{j}" for j in range(30)), notice])
    history = History.create(spark, f"{tmp_path}/h", "bigint", 0.6, SetSketch(bands=1, rows=256))
    sign = lambda rows: sign_records(spark.createDataFrame(rows, SCHEMA), "ingest_id", "batch_no", "text", history.sketch, history.least_words).drop("batch")
    history.start(sign([(k, 0, text(k)) for k in range(50)]))
    fresh = history.scratch.keep(sign([(k, 1, text(k)) for k in range(50, 70)]), "fresh")
    history._append_hashes(history.hash_rows(fresh))
    assert history._candidates(fresh).count() == 0
    history.close()


def test_a_batch_in_another_session(spark, tmp_path):
    rows = [(5_000 - i, min(3, i * 4 // 200), t) for i, t in corpus(seed=9)]
    expected = brute_repeats(rows, 0.6)
    path = f"{tmp_path}/history"
    first = [r for r in rows if r[1] < 3]
    got = {r["id"] for r in repeats_of_accepted(spark.createDataFrame(first, SCHEMA), threshold=0.6, accepted_batch=0, path=path, rows_per_shard=10).collect()}
    other = spark.newSession()
    other.sql("DROP TABLE IF EXISTS none_of_it")
    history = History.open(other, path)
    assert history.delivery == 3 and history.shards > 10
    last = other.createDataFrame([r for r in rows if r[1] == 3], SCHEMA)
    signed = sign_records(last, "ingest_id", "batch_no", "text", history.sketch, history.least_words).drop("batch")
    got |= {r["id"] for r in history.admit(history.scratch.keep(signed, "signed")).collect()}
    assert got == expected
    ids = other.createDataFrame([(rows[0][0],)], "id bigint")
    plan = history.records(ids, "text")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    smaller = history.compact(f"{tmp_path}/compacted")
    assert {r[0] for r in smaller.records(ids, "text").collect()} == {rows[0][0]}
    assert 0 < smaller.hashes(2).count() < history.hashes(2).count()
    history.close()
    smaller.close()


def test_what_a_failed_delivery_left_is_not_read(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(40))
    history = History.create(spark, f"{tmp_path}/h", "bigint", 0.6)
    sign = lambda rows: sign_records(spark.createDataFrame(rows, SCHEMA), "ingest_id", "batch_no", "text", history.sketch, history.least_words).drop("batch")
    history.start(sign([(1, 0, "other words that stand here alone")]))
    fresh = sign([(2, 1, text)])
    history.hash_rows(fresh).selectExpr("hash", "id", "size", "cast(2 as int) delivery", "kind").write.mode("append").insertInto(history.table)
    assert history.admit(sign([(2, 1, text)])).count() == 0
    assert [r[0] for r in history.admit(sign([(3, 2, text)])).collect()] == [3]
    history.close()
