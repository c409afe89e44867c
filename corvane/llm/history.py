"""New batches against everything accepted before, without going through the history again.

The history is kept in a folder: a table of hashes, bucketed by hash (for each accepted record its content hash, the
hashes of its paragraphs and of its sketch bands), and the accepted records themselves, in shards of the id. Another
session opens it by its path. A batch is signed once and meets the hashes in joins that stay within buckets: equal
content hashes are full copies; records of whose words a good part stands in shared paragraphs, and records that share a
band, become candidate pairs. Sketches of the candidates, then texts of the likely ones, are read from the shards that
hold them; what is accepted is appended.

Paragraphs alone miss pairs whose edits touch every paragraph; the bands are there for those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.neardup import band_rows, verify
from corvane.llm.sketch import ODD, SPAN, WORDS, SetSketch, _mix, estimate_pairs, packed, word_hashes
from corvane.session import Scratch, at_most, broadcast_if_small, exists


def sign_records(df: DataFrame, key: str, batch: str, text: str, sketch: SetSketch, least_words: int) -> DataFrame:
    """``(id, batch, content, check, n, words, registers, paragraphs, text)`` of each record with a text; one pass.

    ``content`` and ``check`` are hashes (96 bits together) of the set of five-word runs, or of the normalised text where that has fewer than five words.
    """
    schema = f"id {df.schema[key].dataType.simpleString()}, batch {df.schema[batch].dataType.simpleString()}, content bigint, check int, n int, words int, registers binary, paragraphs array<struct<hash:bigint,size:int>>, text string"
    pair = pa.list_(pa.struct([("hash", pa.int64()), ("size", pa.int32())]))
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content: list[int] = []
        check: list[int] = []

        def digest(x: str | bytes) -> None:
            h = xxhash.xxh3_128_intdigest(x)
            content.append(signed(h & (1 << 64) - 1))
            check.append((h >> 64 & (1 << 32) - 1) - (1 << 31))

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                content.clear()
                check.clear()
                count, total, paragraphs, sets, some = [], [], [], [], []
                for k, t in enumerate(b.column(2).to_pylist()):
                    low = t.lower()
                    lines = [WORDS.findall(x) for x in low.split("\n")]
                    words = [w for x in lines for w in x]
                    total.append(len(words))
                    paragraphs.append([{"hash": signed(xxhash.xxh3_64_intdigest(" ".join(x))), "size": len(x)} for x in lines if len(x) >= least_words])
                    if len(words) < SPAN:
                        digest("t" + " ".join(low.split()))
                        count.append(0)
                        continue
                    h = word_hashes(words)
                    with np.errstate(over="ignore"):
                        s = h[: len(h) - SPAN + 1].copy()
                        for i in range(1, SPAN):
                            s = _mix(s * ODD + h[i : len(h) - SPAN + 1 + i])
                    s = np.unique(s)
                    digest(s.tobytes())
                    count.append(len(s))
                    sets.append(s)
                    some.append(k)
                registers = np.empty(b.num_rows, object)
                if sets:
                    registers[some] = packed(sketch.registers(sets)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(content, pa.int64()), pa.array(check, pa.int32()), pa.array(count, pa.int32()), pa.array(total, pa.int32()), pa.array(registers, pa.binary()), pa.array(paragraphs, pair), b.column(2)],
                    names=["id", "batch", "content", "check", "n", "words", "registers", "paragraphs", "text"],
                )

    return df.where(F.col(key).isNotNull() & F.col(batch).isNotNull() & F.col(text).isNotNull()).select(key, batch, text).mapInArrow(run, schema)


class History:
    """Accepted records in a folder of shared storage, and the batches that are held against them.

    ``hashes`` (hash, id, size, delivery, kind) is a table bucketed by hash: kind 0 holds contents (size is a second hash
    of the content), 1 paragraphs (size in words), 2 sketch bands. ``records`` (id, n, words, registers, text, delivery)
    holds the accepted records in shards of the id; ``struck`` (id) those that repeated something, whose hashes are in the
    table but name no candidates. ``log`` has a row for each delivery that was taken in whole. Rows of one that failed
    half way are not read until its repetition writes them again, where doubles do no harm.

    Two records repeat each other if their normalised texts are equal or their five-word runs have a Jaccard similarity of
    at least ``threshold``.
    """

    def __init__(self, spark: SparkSession, path: str, state: dict) -> None:
        self.spark, self.path, self.state = spark, path.rstrip("/"), state
        self.id_type, self.buckets, self.shards = state["id_type"], int(state["buckets"]), int(state["shards"])
        self.threshold, self.coverage, self.least_words = float(state["threshold"]), float(state["coverage"]), int(state["least_words"])
        self.sketch = SetSketch(bands=int(state["bands"]), rows=int(state["rows"]))
        self.scratch = Scratch(spark, "history")
        self.table = "history_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        spark.sql(
            f"CREATE TABLE {self.table} (hash BIGINT, id {self.id_type}, size INT, delivery INT, kind INT) USING parquet "
            f"PARTITIONED BY (kind) CLUSTERED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.path}/hashes'"
        )
        self.delivery = 0
        if exists(spark, f"{self.path}/log"):
            spark.catalog.recoverPartitions(self.table)
            self.delivery = spark.read.parquet(f"{self.path}/log").agg(F.max("delivery")).first()[0] or 0

    @classmethod
    def create(cls, spark: SparkSession, path: str, id_type: str, threshold: float = 0.8, sketch: SetSketch | None = None, coverage: float = 0.5, least_words: int = 8, buckets: int = 8, shards: int = 1) -> History:
        """An empty history. ``buckets`` and ``shards`` stay as they are; choose them for the size it will have."""
        sketch = sketch or SetSketch(bands=64)
        state = {"id_type": id_type, "buckets": buckets, "shards": shards, "threshold": threshold, "coverage": coverage, "least_words": least_words, "bands": sketch.bands, "rows": sketch.rows}
        spark.createDataFrame([(k, str(v)) for k, v in state.items()], "name string, value string").coalesce(1).write.parquet(f"{path.rstrip('/')}/state")
        return cls(spark, path, state)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """A history that another session wrote; reads its few parameters and the log, no record."""
        return cls(spark, path, {r["name"]: r["value"] for r in spark.read.parquet(f"{path.rstrip('/')}/state").collect()})

    # --- reading and writing ---------------------------------------------------------------------------------------
    def hashes(self, kind: int, delivery: int | None = None) -> DataFrame:
        """Hashes of one kind up to a delivery, by default the last one that was taken."""
        return self.spark.table(self.table).where((F.col("kind") == kind) & (F.col("delivery") <= (self.delivery if delivery is None else delivery)))

    def records(self, ids: DataFrame, *columns: str) -> DataFrame:
        """Columns of the accepted records with these ids. Only the shards that hold one are read."""
        got = self.spark.read.schema(f"id {self.id_type}, n int, words int, registers binary, text string, delivery int, shard int").parquet(f"{self.path}/records").where(F.col("delivery") <= self.delivery)
        if self.shards > 1:
            wanted = [r[0] for r in ids.select(self._shard("id").alias("s")).distinct().collect()]  # at most ``shards`` numbers
            got = got.where(F.col("shard").isin(wanted))
        return got.select("id", *columns).join(broadcast_if_small(ids, 1_000_000), "id", "left_semi").dropDuplicates(["id"])

    def _shard(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.shards)).cast("int")

    def _append_hashes(self, rows: DataFrame) -> None:
        number = F.lit(self.delivery + 1).cast("int").alias("delivery")
        rows.select("hash", "id", "size", number, "kind").repartition(self.buckets, "hash").write.mode("append").insertInto(self.table)

    def _commit(self, accepted: DataFrame) -> None:
        number = F.lit(self.delivery + 1).cast("int").alias("delivery")
        kept = accepted.select("id", "n", "words", "registers", "text", number, self._shard("id").alias("shard"))
        kept.write.mode("append").partitionBy("shard").parquet(f"{self.path}/records")
        self.delivery += 1
        self.spark.range(1).select(F.lit(self.delivery).alias("delivery")).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def struck(self) -> DataFrame | None:
        path = f"{self.path}/struck"
        return self.spark.read.schema(f"id {self.id_type}, delivery int").parquet(path).select("id").distinct() if exists(self.spark, path) else None

    def compact(self, path: str) -> History:
        """The same history in another folder, each bucket and shard in one run of files; deliveries leave many small ones.
        Hashes of struck records, but for their contents, stay behind."""
        new = History.create(self.spark, path, self.id_type, self.threshold, self.sketch, self.coverage, self.least_words, self.buckets, self.shards)
        if self.delivery:
            gone = self.struck()
            rows = self.hashes(1).union(self.hashes(2)).drop("delivery").distinct()
            rows = rows.join(gone, "id", "left_anti") if gone is not None else rows
            new._append_hashes(rows.unionByName(self.hashes(0).drop("delivery").distinct()))
            fresh = self.spark.read.parquet(f"{self.path}/records").where(F.col("delivery") <= self.delivery).dropDuplicates(["id"])
            new._commit(fresh.repartition(self.shards, "shard"))
        return new

    def hash_rows(self, fresh: DataFrame) -> DataFrame:
        """``(hash, id, size, kind)`` of records: content, paragraphs, bands."""
        long = fresh.where("n > 0")
        paragraph = long.select("id", F.explode(F.array_distinct("paragraphs")).alias("p"))
        return (
            fresh.select(F.col("content").alias("hash"), "id", F.col("check").alias("size"), F.lit(0).alias("kind"))
            .union(paragraph.select("p.hash", "id", "p.size", F.lit(1)))
            .union(band_rows(long, self.sketch).select(F.col("band"), "id", F.lit(0), F.lit(2)))
        )

    # --- a delivery ------------------------------------------------------------------------------------------------
    def _fresh(self, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(ids, records) of the signed records that are the first of their content, which the history hasn't got."""
        first = signed.groupBy("content", "check").agg(F.min("id").alias("id"))
        if self.delivery:
            known = self.hashes(0).select(F.col("hash").alias("content"), F.col("size").alias("check"))
            asked = first.select("content", "check").hint("shuffle_hash")
            first = first.join(known.join(asked, ["content", "check"], "left_semi").distinct(), ["content", "check"], "left_anti")
        ids = self.scratch.keep(first.select("id"), "ids")
        return ids, signed.join(broadcast_if_small(ids, 1_000_000), "id", "left_semi").dropDuplicates(["id"])

    def start(self, signed: DataFrame) -> None:
        """Take signed records as accepted without a look at each other; one of each content stands for its copies."""
        ids, fresh = self._fresh(signed)
        self._append_hashes(self.hash_rows(fresh))
        self._commit(fresh)
        self.scratch.drop(ids)

    def admit(self, signed: DataFrame) -> DataFrame:
        """``(id)`` of the signed records that repeat an accepted one or an earlier accepted one of the same delivery.

        Copies of known contents go at once: what they copy was accepted or repeats an accepted record, as they then do
        too. The hashes of the others are appended, so that joins within the buckets, which shuffle nothing, find their
        partners in the history and in the delivery. Candidates are estimated from the sketches, and only texts of likely
        ones are fetched and compared. ``signed`` should be a written table: it is read several times.
        """
        ids, fresh = self._fresh(signed)
        self._append_hashes(self.hash_rows(fresh))
        edges = self._edges(self._candidates(fresh), fresh)
        self._resolve(edges).select("id").write.mode("append").parquet(f"{self.path}/struck/delivery={self.delivery + 1}")
        down = broadcast_if_small(self.struck(), 1_000_000)
        accepted = self.scratch.keep(ids.join(down, "id", "left_anti"), "accepted")
        kept = broadcast_if_small(accepted, 1_000_000)
        self._commit(fresh.join(kept, "id", "left_semi"))
        out = self.scratch.keep(signed.select("id").join(kept, "id", "left_anti").distinct(), "repeats")
        self.scratch.drop(ids, edges, accepted)
        return out

    def _candidates(self, fresh: DataFrame) -> DataFrame:
        """``(id_a, id_b, old)``: pairs that share a band or, of id_b's words, enough paragraphs; old: id_a is in the history.

        Paragraphs that very many records hold are looked up only as far as they matter. Those of a record are put in
        order of how often they occur, and the most frequent ones are set aside while they make up less than the share
        that is asked for: a pair that shares enough must then share one of the others. Nothing is lost by that, and the
        notice at the foot of every page makes no pairs.
        """
        now = self.delivery + 1
        own = F.col("delivery") == now
        side = lambda kind: self.hashes(kind, now).select("hash", F.col("id").alias("id_a"), (F.col("delivery") < now).alias("old"))
        bands = self.hashes(2, now).where(own).select("hash", F.col("id").alias("id_b"))
        met = side(2).join(bands.hint("shuffle_hash"), "hash").where("old OR id_a < id_b").select("id_a", "id_b", "old")

        paragraphs = self.hashes(1, now).where(own).select("hash", "id", "size")
        often = self.hashes(1, now).select("hash").join(paragraphs.select("hash").hint("shuffle_hash"), "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("many"))
        ranked = paragraphs.join(often, "hash").join(fresh.select("id", "words"), "id")
        hot_first = Window.partitionBy("id").orderBy(F.desc("many"), "hash").rowsBetween(Window.unboundedPreceding, 0)
        ranked = ranked.withColumn("reach", F.sum("size").over(hot_first)).where(F.col("reach") >= self.coverage * F.col("words"))
        # the one that crosses the line is looked up too; what was set aside may all be shared
        aside = F.min(F.col("reach") - F.col("size")).over(Window.partitionBy("id"))
        asked = ranked.withColumn("aside", aside).select("hash", F.col("id").alias("id_b"), "size", "words", "aside")
        shared = side(1).join(asked.hint("shuffle_hash"), "hash").where("old OR id_a <> id_b")
        shared = shared.groupBy("id_a", "id_b", "old", "words", "aside").agg(F.sum("size").alias("size")).where(F.col("size") + F.col("aside") >= self.coverage * F.col("words"))
        turned = F.when(F.col("old") | (F.col("id_a") < F.col("id_b")), F.struct("id_a", "id_b", "old")).otherwise(F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "old"))
        pairs = met.union(shared.select(turned.alias("p")).select("p.*"))
        gone = self.struck()
        if gone is not None:
            pairs = pairs.join(broadcast_if_small(gone.withColumnRenamed("id", "id_a"), 1_000_000), "id_a", "left_anti")
        return self.scratch.keep(pairs.select("id_a", "id_b", "old").distinct(), "pairs")

    def _edges(self, pairs: DataFrame, fresh: DataFrame) -> DataFrame:
        """``(id_a, id_b, old)`` of the pairs whose exact similarity reaches the threshold."""
        keep = self.scratch.keep

        def both(of: DataFrame, *columns: str) -> DataFrame:
            """The pairs with columns of both records, wherever the first one is."""
            right = fresh.select(F.col("id").alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
            named = lambda df: df.select(F.col("id").alias("id_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
            new = of.where("NOT old").join(named(fresh), "id_a")
            if self.delivery:
                ids = of.where("old").select(F.col("id_a").alias("id")).distinct()
                new = new.union(of.where("old").join(named(self.records(ids, *columns)), "id_a"))
            return new.join(right, "id_b")

        estimated = both(pairs, "n", "registers").select("id_a", "id_b", F.col("n_a"), F.col("n_b"), F.col("registers_a").alias("r_a"), F.col("registers_b").alias("r_b"), "old")
        likely = keep(estimate_pairs(estimated, self.sketch, self.threshold, keep=("old",)), "likely")
        edges = keep(verify(both(likely, "text").select("id_a", "id_b", "text_a", "text_b", "old"), self.threshold, keep=("old",)).select("id_a", "id_b", "old"), "edges")
        self.scratch.drop(pairs, likely)
        return edges

    def _resolve(self, edges: DataFrame, at_once: int = 1_000_000) -> DataFrame:
        """``(id)`` of the fresh records with an earlier accepted neighbour, earlier decisions first.

        So many edges are walked by one task. More are settled in rounds: a record whose earlier neighbours are all in the
        history or settled is decided in the next one, so the rounds are as many as the longest chain of neighbours within
        the delivery, not as the records; each of them costs the driver several jobs.
        """
        if at_most(edges, at_once):
            return edges.select("id_a", "id_b", "old").coalesce(1).mapInArrow(_settled, f"id {self.id_type}")
        keep = self.scratch.keep
        down = edges.where("old").select(F.col("id_b").alias("id")).distinct()
        alive = lambda e, gone: e.join(gone.withColumnRenamed("id", "id_a"), "id_a", "left_anti").join(gone.withColumnRenamed("id", "id_b"), "id_b", "left_anti")
        left = keep(alive(edges.where("NOT old").select("id_a", "id_b"), down), "left")
        while left.limit(1).count():
            roots = left.select("id_a").distinct().join(left.select(F.col("id_b").alias("id_a")), "id_a", "left_anti")
            gone = keep(left.join(roots, "id_a", "left_semi").select(F.col("id_b").alias("id")).distinct(), "gone")
            down = down.union(gone)
            left = keep(alive(left, gone), "left")
        return down

    def close(self) -> None:
        """Forget the table's name in this session and delete what only served the deliveries; the history stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all edges (id_a, id_b, old), id_a before id_b unless it is old: each id_b that has an old or an accepted id_a."""
    held = list(batches)
    if not held:
        return
    edges, down = pa.Table.from_batches(held).sort_by("id_b"), set()
    for a, b, old in zip(*[edges.column(k).to_pylist() for k in range(3)]):
        if old or a not in down:
            down.add(b)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(down), edges.schema.field("id_b").type)], names=["id"])


def repeats_of_accepted(
    df: DataFrame,
    key: str = "ingest_id",
    batch: str = "batch_no",
    text: str = "text",
    threshold: float = 0.8,
    sketch: SetSketch | None = None,
    least_words: int = 8,
    accepted_batch: int | None = None,
    rows_per_bucket: int = 2_000_000,
    rows_per_shard: int = 200_000,
    path: str | None = None,
) -> DataFrame:
    """``(id, batch)``: the records that repeat an accepted one, batch after batch.

    Records count in order of batch and key. All of ``accepted_batch`` (the history) is accepted as it is. Null texts
    repeat nothing and are repeated by nothing; empty and shorter texts repeat only an equal normalised text. Rows with a
    null key or batch are left out; rows that repeat a key within a batch count once; an empty table gives no rows; other
    columns are not read. The batches are few and walked one after the other, as they would arrive. The history is made
    in ``path``, where ``History.open`` finds it for the next batch, or in the scratch folder. Its buckets hold about
    ``rows_per_bucket`` hashes each, its shards ``rows_per_shard`` records.
    """
    sketch = sketch or SetSketch(bands=64)
    spark = df.sparkSession
    scratch = Scratch(spark, "batches")
    at = scratch.path("signed")
    signs = sign_records(df, key, batch, text, sketch, least_words)
    signs.write.partitionBy("batch").parquet(at)
    signed = spark.read.schema(signs.select(*[c for c in signs.columns if c != "batch"], "batch").schema).parquet(at)
    sizes = {r[0]: r[1] for r in signed.groupBy("batch").agg(F.count("*")).collect()}  # one row per batch
    rows = sum(sizes.values())
    buckets = max(spark.sparkContext.defaultParallelism, -(-rows * (sketch.bands + 12) // rows_per_bucket))
    history = History.create(spark, path or scratch.path("history"), df.schema[key].dataType.simpleString(), threshold, sketch, 0.5, least_words, buckets, -(-rows // rows_per_shard) or 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", history.buckets)  # joins keep to the buckets, however many partitions are usual
    found = None
    try:
        for number in sorted(sizes):
            part = signed.where(F.col("batch") == number).drop("batch")
            if number == accepted_batch:
                history.start(part)
                continue
            got = history.admit(part).select("id", F.lit(number).cast(signed.schema["batch"].dataType).alias("batch"))
            found = got if found is None else found.union(got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        history.close()
    scratch.drop(*([signed] if path else []))  # without a path the history goes too
    return found if found is not None else spark.createDataFrame([], signed.select("id", "batch").schema)
