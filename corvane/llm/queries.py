"""Queries of the text problems, with SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.history import repeats_of_accepted
from corvane.llm.langid import languages_of
from corvane.llm.maincontent import main_content
from corvane.llm.mixing import mix
from corvane.llm.neardup import near_duplicates
from corvane.llm.packing import pack_documents
from corvane.llm.sitelines import repeated_lines
from corvane.llm.stuffing import stuffed_pages
from corvane.session import read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    got = languages_of(read(spark, d, "documents"), read(spark, d, "lang_samples"))
    return got.where((F.col("line_no") > 0) | F.col("wrong")).select("doc_id", "line_no", "lang")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(read(spark, d, "documents")).select(F.col("id").alias("doc_id"), "line_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content(read(spark, d, "crawl_pages"), source="source").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = repeats_of_accepted(read(spark, d, "ingest_docs"), threshold=0.6, accepted_batch=0)
    return found.select(F.col("id").alias("ingest_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = near_duplicates(read(spark, d, "documents"), threshold=0.6)
    return found.pairs().select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(read(spark, d, "documents"), read(spark, d, "pack_capacities"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the least number that could do, and the share of their space that is used."""
    capacities = read(spark, d, "pack_capacities")
    used = p8_pack(spark, d).groupBy("capacity_id", "container").agg(F.sum("tokens").alias("tokens"))
    used = used.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    used = used.join(F.broadcast(capacities.select("capacity_id", "capacity_tokens")), "capacity_id")
    return used.select("capacity_id", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(read(spark, d, "documents"), read(spark, d, "mix_targets")).plan


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(read(spark, d, "documents"), read(spark, d, "mix_targets")).shares


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages(read(spark, d, "documents"), read(spark, d, "lang_samples"), shares=False).where("stuffed").select("doc_id")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found,
    "p8_pack": p8_pack, "p8_fill": p8_fill, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found,
}
SQL: dict[str, str] = {
    "p3_found": r"""
        WITH lines AS (
          SELECT doc_id, source, CAST(i AS INTEGER) AS line_no, regexp_replace(lower(split_part(text, chr(10), CAST(i AS INTEGER))), '[^\p{L}]+', '', 'g') AS letters
          FROM documents, unnest(range(1, length(text) - length(replace(text, chr(10), '')) + 2)) AS t(i)
          WHERE text IS NOT NULL AND source IS NOT NULL
        ), often AS (
          SELECT source, letters FROM lines WHERE length(letters) >= 12 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 5
        )
        SELECT doc_id, line_no FROM lines SEMI JOIN often USING (source, letters)""",
}
