"""Exact and near duplicates in the order of arrival: duplicates are flagged, never dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import Scratch

#: Fixed values of the sketch: permutations, bands, words in a run, seed of the permutations.
PERMUTATIONS, BANDS, RUN, SEED = 112, 14, 5, 112_358


def exact_duplicates(df: DataFrame, digest: str, key: str, ordinal: str, ledger: DataFrame | None = None) -> DataFrame:
    """``df`` with ``duplicate_of``: the ledger's owner of the digest, else the first row of the batch that has it.

    ``ledger`` gives ``id, digest, status, created_at``; its owner is the oldest row that isn't deleted (ties by id). A
    document is no duplicate of itself. Owners come from aggregates that combine before the shuffle, so a digest that a
    third of all rows share costs one row per input partition.
    """
    first = df.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("_digest")).agg(F.min(F.struct(F.col(ordinal).alias("o"), F.col(key).alias("k"))).alias("_first"))
    owner = F.col("_first.k")
    out = df.join(first, F.col(digest) == F.col("_digest"), "left")
    if ledger is not None:
        own = ledger.where((F.col("status") != "deleted") & F.col("digest").isNotNull()).groupBy(F.col("digest").alias("_ledger_digest")).agg(F.min(F.struct("created_at", "id")).alias("_own"))
        out = out.join(own, F.col(digest) == F.col("_ledger_digest"), "left")
        owner = F.coalesce(F.col("_own.id"), owner)
    return out.withColumn("duplicate_of", F.when(owner != F.col(key), owner)).drop("_digest", "_first", "_ledger_digest", "_own")


def keep_first(df: DataFrame, group: Column, ordinal: str, cap: int = 2) -> DataFrame:
    """The first ``cap`` rows of each group; the rank filter is applied before the shuffle too, so large groups stay small."""
    at = Window.partitionBy(group).orderBy(ordinal)
    return df.withColumn("_rank", F.row_number().over(at)).where(F.col("_rank") <= cap).drop("_rank")


def signature_bands(df: DataFrame, key: str, text: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """``(key, band, value, *kept)`` with 64-bit wraparound arithmetic over xxh64 hashes modulo 2^61 - 1; one Arrow pass.

    Texts with fewer than five words have no rows.
    """
    g = np.random.default_rng(seed=SEED)
    prime = np.uint64((1 << 61) - 1)
    a, b = g.integers(1, prime, size=PERMUTATIONS, dtype=np.uint64), g.integers(0, prime, size=PERMUTATIONS, dtype=np.uint64)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, band smallint, value bigint" + "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"\w+")
        width = PERMUTATIONS // BANDS
        for batch in batches:
            rows, values = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                w = word.findall((t or "").lower())
                if len(w) < RUN:
                    continue
                distinct = {" ".join(w[i : i + RUN]) for i in range(len(w) - RUN + 1)}
                h = np.fromiter((xxhash.xxh64_intdigest(s) for s in distinct), "uint64", len(distinct))
                least = np.full(PERMUTATIONS, np.iinfo("uint64").max, "uint64")
                with np.errstate(over="ignore"):
                    for at in range(0, len(h), 1024):
                        least = np.minimum(least, ((h[at : at + 1024, None] * a + b) % prime).min(0))
                rows.append(k)
                values += [xxhash.xxh64_intdigest(least[i * width : (i + 1) * width].tobytes()) for i in range(BANDS)]
            again = pa.array(np.repeat(np.array(rows, "int64"), BANDS))
            columns = [batch.column(0).take(again), pa.array(np.tile(np.arange(BANDS, dtype="int16"), len(rows))), pa.array(np.array(values, "uint64").view("int64"))]
            yield pa.RecordBatch.from_arrays([*columns, *[batch.column(2 + i).take(again) for i in range(len(kept))]], names=[key, "band", "value", *kept])

    return df.select(key, text, *kept).mapInArrow(run, schema)


def band_pairs(bands: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Distinct ``(earlier, later)`` of documents that share a band, by ordinal.

    ``bands`` has key, ordinal, band, value. Bands that only one document has are left out before the join.
    """
    often = bands.groupBy("band", "value").agg(F.count("*").alias("many")).where("many > 1").select("band", "value")
    rows = bands.join(often, ["band", "value"], "left_semi").select("band", "value", F.col(key).alias("k"), F.col(ordinal).alias("o"))
    a, b = rows.select("band", "value", F.col("k").alias("earlier"), F.col("o").alias("oa")), rows.select("band", "value", F.col("k").alias("later"), F.col("o").alias("ob"))
    return a.join(b, ["band", "value"]).where("oa < ob").select("earlier", "later").distinct()


def greedy_duplicates(edges: DataFrame, spark=None) -> DataFrame:
    """``(id, duplicate_of)`` when documents are taken in order and one that matches an earlier kept document is dropped.

    ``edges`` is (earlier, later) with ids that sort in the order of arrival. This isn't a connected component: in a chain
    a - b - c without a - c, b is dropped for a and c stays. A node whose earlier neighbours are all settled is settled in
    the next round; the rounds are as many as the longest chain. Each round is written to shared storage.
    """
    scratch = Scratch(edges.sparkSession, "greedy")
    left = scratch.keep(edges.select("earlier", "later").distinct(), "edges")
    dropped = None
    while left.limit(1).count():
        roots = left.select("earlier").distinct().join(left.select(F.col("later").alias("earlier")), "earlier", "left_anti")
        gone = scratch.keep(left.join(roots, "earlier", "left_semi").groupBy(F.col("later").alias("id")).agg(F.min("earlier").alias("duplicate_of")), "gone")
        dropped = gone if dropped is None else dropped.union(gone)
        ids = gone.select("id")
        left = scratch.keep(left.join(ids.withColumnRenamed("id", "later"), "later", "left_anti").join(ids.withColumnRenamed("id", "earlier"), "earlier", "left_anti"), "edges")
    if dropped is None:
        kind = edges.schema["later"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"id {kind}, duplicate_of {kind}")
    return dropped


def prune_bands(store: DataFrame, day: str, window_days: int, today: Column) -> DataFrame:
    """The rolling band store without days older than the window."""
    return store.where(F.col(day) >= F.date_sub(today, window_days))
