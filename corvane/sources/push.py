"""Pushed documents: validation, partitions, identities and metadata, as columns with a reason for every rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUSHED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("published_at", T.StringType()), T.StructField("fields", T.StringType()), T.StructField("payload", T.StringType()),
])


def read_push(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of pushed documents; ``fields`` and ``payload`` stay JSON text. No inference."""
    return spark.read.schema(PUSHED).json(path)


def conversation_of(id_: Column, fields: Column) -> Column:
    """Partition of a memory document: its conversation_id, else its id up to the first slash."""
    explicit = F.nullif(F.trim(F.get_json_object(fields, "$.conversation_id")), F.lit(""))
    return F.coalesce(explicit, F.when(id_.contains("/"), F.nullif(F.split_part(id_, F.lit("/"), F.lit(1)), F.lit(""))))


def memory_suffix(partition: Column, index: Column, given: Column | None = None) -> Column:
    """``partition/00007``, or the given suffix."""
    made = F.format_string("%s/%05d", partition, index)
    return F.coalesce(given, made) if given is not None else made


def range_is_valid(message_range: Column) -> Column:
    """Null, or [start, end] with 0 <= start <= end."""
    return message_range.isNull() | F.coalesce((F.size(message_range) == 2) & (F.get(message_range, F.lit(0)) >= 0) & (F.get(message_range, F.lit(0)) <= F.get(message_range, F.lit(1))), F.lit(False))


def merged_metadata(payload: Column, fields: Column) -> Column:
    """Public metadata of a document: payload overlaid by its fields, names with a leading underscore hidden."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(payload, none), F.coalesce(fields, none)
    return F.map_filter(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), lambda k, _: ~F.startswith(k, F.lit("_")))


def checked(docs: DataFrame, max_text: int = 16_000) -> DataFrame:
    """Pushed documents with ``reason``: '' or what is wrong: no id, no text, text too long, bad range, id outside partition."""
    partition = conversation_of(F.col("id"), F.col("fields"))
    span = F.from_json(F.get_json_object("fields", "$.message_range"), "array<int>")
    present = F.get_json_object("fields", "$.message_range").isNotNull()
    reason = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "id").when(F.coalesce(F.trim("text"), F.lit("")) == "", "text").when(F.length("text") > max_text, "length")
        .when(present & (span.isNull() | ~range_is_valid(span)), "range").when(partition.isNotNull() & F.col("id").contains("/") & ~F.startswith("id", F.concat(partition, F.lit("/"))), "partition").otherwise("")
    )
    return docs.withColumn("partition", partition).withColumn("reason", reason)


def push(docs: DataFrame, mode: str = "delta", partition: str | None = None, max_docs: int = 500) -> DataFrame:
    """Accepted documents of one push; raises where the batch is too large, has a bad document or mixes partitions.

    A full push replaces its partition: an empty one gives a single coverage row, so that the partition can be cleared.
    """
    if mode not in ("delta", "full_set"):
        raise ValueError(f"unknown mode {mode}")
    rows = checked(docs)
    facts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("reason") != "").alias("bad"), F.count_distinct("partition").alias("partitions"), F.min(F.when(F.col("reason") != "", F.col("reason"))).alias("why")).first()
    if facts["n"] > max_docs:
        raise ValueError(f"{facts['n']} documents; at most {max_docs}")
    if facts["bad"]:
        raise ValueError(f"{facts['bad']} documents are rejected: {facts['why']}")
    if facts["partitions"] > 1:
        raise ValueError("the batch mixes partitions")
    out = rows.drop("reason").withColumn("is_coverage", F.lit(False))
    if partition is not None:
        out = out.withColumn("partition", F.coalesce("partition", F.lit(partition)))
    if mode == "full_set" and not facts["n"]:
        if partition is None:
            raise ValueError("an empty full push names its partition")
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema]
        out = docs.sparkSession.range(1).select(*blank, F.lit(partition).alias("partition"), F.lit(True).alias("is_coverage"))
    return out
