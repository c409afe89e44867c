"""Near-duplicate texts by SetSketch registers: band, estimate, verify.

1. One pass signs each text: hash of its set of five-word runs, size of the set, packed registers.
2. Texts with the same set form a class; only its representative goes on, so a text that is copied into a third of all
   rows costs one.
3. Bands of registers become keys. Keys that two representatives share name a candidate pair; a single aggregate finds
   them, and only keys shared by three or more go through a join, which AQE splits where it is skewed.
4. The likelihood of the registers drops candidates that can't reach the threshold; the rest are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.sketch import SetSketch, estimate_pairs, jaccard, packed, shingle_hashes, unpacked
from corvane.session import Scratch, broadcast_if_small


def sign(df: DataFrame, key: str, text: str, sketch: SetSketch, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(id, full, n, registers, *extra)`` of every text with at least five words."""
    schema = f"id {df.schema[key].dataType.simpleString()}, full binary, n int, registers binary" + "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = [shingle_hashes(t) for t in b.column(1).to_pylist()]
                rows = [k for k, s in enumerate(sets) if len(s)]
                sets = [sets[k] for k in rows]
                take = pa.array(rows, pa.int64())
                full = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), full, pa.array([len(s) for s in sets], pa.int32()), packed(sketch.registers(sets)), *[b.column(2 + k).take(take) for k in range(len(extra))]],
                    names=["id", "full", "n", "registers", *extra],
                )

    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text, *extra).mapInArrow(run, schema)


def band_rows(signed: DataFrame, sketch: SetSketch, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(band, id, *extra)``: one row for each band of each text."""
    schema = f"band bigint, id {signed.schema['id'].dataType.simpleString()}" + "".join(f", `{c}` {signed.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = sketch.band_keys(unpacked(b.column(1), "uint16"))
                again = pa.array(np.repeat(np.arange(b.num_rows), sketch.bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column(0).take(again), *[b.column(2 + k).take(again) for k in range(len(extra))]], names=["band", "id", *extra])

    return signed.select("id", "registers", *extra).mapInArrow(run, schema)


def candidates(bands: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct ``(id_a, id_b)``, id_a < id_b, of texts that share a band.

    The shared keys are few and written once; the bands are shuffled once for them, and a second time only as far as
    their key is shared by three or more.
    """
    keys = bands.groupBy("band").agg(F.min("id").alias("id_a"), F.max("id").alias("id_b"), F.count("*").alias("many")).where("id_a < id_b")
    keys = scratch.keep(keys, "keys")
    two = keys.where("many = 2").select("id_a", "id_b")
    more = bands.join(broadcast_if_small(keys.where("many > 2").select("band"), 1_000_000), "band", "left_semi")
    left, right = more.select("band", F.col("id").alias("id_a")), more.select("band", F.col("id").alias("id_b"))
    return two.union(left.join(right, "band").where("id_a < id_b").select("id_a", "id_b")).distinct()


def verify(pairs: DataFrame, threshold: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id_a, id_b, similarity, *keep)`` of the pairs (id_a, id_b, text_a, text_b, *keep) whose exact similarity reaches the threshold."""
    kind = pairs.schema["id_a"].dataType.simpleString()
    more = "".join(f", `{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            memo: dict[str, np.ndarray] = {}

            def of(t: str) -> np.ndarray:
                if t not in memo:
                    memo[t] = shingle_hashes(t)
                return memo[t]

            got = pa.array([jaccard(of(x), of(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.float64())
            chosen = pa.array(got.to_numpy(zero_copy_only=False) >= threshold - 1e-12)
            columns = [b.column(0), b.column(1), got, *[b.column(4 + k) for k in range(len(keep))]]
            yield pa.RecordBatch.from_arrays([c.filter(chosen) for c in columns], names=["id_a", "id_b", "similarity", *keep])

    return pairs.select("id_a", "id_b", "text_a", "text_b", *keep).mapInArrow(run, f"id_a {kind}, id_b {kind}, similarity double{more}")


def verified(pairs: DataFrame, texts: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """``(id_a, id_b, similarity)`` of the pairs whose exact similarity reaches the threshold."""
    body = texts.select(F.col(key).alias("id"), F.col(text).alias("t"))
    both = pairs.join(body.withColumnsRenamed({"id": "id_a", "t": "text_a"}), "id_a").join(body.withColumnsRenamed({"id": "id_b", "t": "text_b"}), "id_b")
    return verify(both, threshold)


@dataclass
class NearDuplicates:
    """``members`` (id, cls): class of each text, named by its smallest id. ``links`` (id_a, id_b, similarity): pairs of classes."""

    members: DataFrame
    links: DataFrame

    def documents(self) -> DataFrame:
        """``(id, cls, links)``: one row per text with its class and the number of other classes it is similar to."""
        ends = self.links.select(F.explode(F.array("id_a", "id_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
        return self.members.join(ends, "cls", "left").select("id", "cls", F.coalesce("links", F.lit(0)).alias("links"))

    def pairs(self) -> DataFrame:
        """Every similar pair of ids, smaller first; copies are expanded here, by joins on the class."""
        sizes = self.members.groupBy("cls").agg(F.count("*").alias("size")).where("size > 1")
        between = self.links.select(F.col("id_a").alias("ca"), F.col("id_b").alias("cb"))
        within = sizes.select(F.col("cls").alias("ca"), F.col("cls").alias("cb"))
        a, b = self.members.select(F.col("cls").alias("ca"), F.col("id").alias("ia")), self.members.select(F.col("cls").alias("cb"), F.col("id").alias("ib"))
        both = between.union(within).join(a, "ca").join(b, "cb").where("ca <> cb OR ia < ib")
        return both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).where("id_a < id_b").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, sketch: SetSketch | None = None) -> NearDuplicates:
    """Texts whose sets of five-word runs have a Jaccard similarity of at least ``threshold``.

    With the default sketch (64 bands of 4 registers) a pair at similarity 0.6 is missed with a probability of 1.4e-4, one
    at 0.65 of 3e-6; candidates are compared exactly, so no wrong pair comes out. Texts that are null or have fewer than
    five words, and rows with a null key, belong to no class. Equal texts, and texts with equal sets, are one class.
    Repeated rows count once. An empty table gives empty results. Other columns are not read.
    """
    sketch = sketch or SetSketch()
    scratch = Scratch(df.sparkSession, "neardup")
    signed = scratch.keep(sign(df, key, text, sketch), "signed")
    full = signed.select("full", "id").groupBy("full").agg(F.min("id").alias("cls"), F.max("id").alias("last"), F.count("*").alias("many"))
    copied = full.where("many > 1").select("full", "cls")
    members = signed.select("full", "id").join(copied, "full", "left").select("id", F.coalesce("cls", "id").alias("cls")).distinct()
    copies = members.where("id <> cls").select("id")
    reps = signed.join(broadcast_if_small(copies, 1_000_000), "id", "left_anti")
    found = scratch.keep(candidates(band_rows(reps, sketch), scratch), "candidates")
    ends = found.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    taken = scratch.keep(signed.select("id", "n", "registers").join(ends, "id", "left_semi").dropDuplicates(["id"]), "taken")
    side = lambda x: taken.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    likely = scratch.keep(estimate_pairs(found.join(side("a"), "id_a").join(side("b"), "id_b"), sketch, threshold), "likely")
    ends = likely.select(F.explode(F.array("id_a", "id_b")).alias(key)).distinct()
    texts = df.where(F.col(key).isNotNull()).select(key, text).join(ends, key, "left_semi").dropDuplicates([key])
    links = scratch.keep(verified(likely, scratch.keep(texts, "texts"), key, text, threshold), "links")
    scratch.drop(found, taken)
    return NearDuplicates(members, links)
