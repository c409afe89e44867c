"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _TS = T.StringType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


#: Columns of staged documents by kind of source.
STAGED: dict[str, T.StructType] = {
    "news": _schema(id=_S, url=_S, title=_S, text=_S, canonical_url=_S, published_at=_TS, lang=_S),
    "wiki": _schema(id=_S, url=_S, title=_S, text=_S, revision_ts=_TS, incoming_links=T.LongType(), opening_text=_S),
    "hn": _schema(id=_S, url=_S, target_url=_S, title=_S, story_text=_S, author=_S, points=T.LongType(), num_comments=T.LongType(), created_at=_TS),
    "arxiv": _schema(id=_S, url=_S, title=_S, abstract=_S, authors=T.ArrayType(_S), categories=_S, primary_category=_S, published_at=_TS),
    "github": _schema(id=_S, url=_S, title=_S, text=_S, stars=T.LongType(), topics=T.ArrayType(_S), language=_S),
    "docs": _schema(id=_S, url=_S, title=_S, text=_S, framework=_S, path=_S, version=_S),
    "hf": _schema(id=_S, url=_S, title=_S, text=_S, root=_S, kind=_S, version=_S),
    "smallweb": _schema(id=_S, url=_S, title=_S, text=_S, canonical_url=_S, published_at=_TS),
    "memory": _schema(id=_S, url=_S, title=_S, text=_S, published_at=_TS, conversation_id=_S, chunk_index=T.IntegerType(), message_range=T.ArrayType(T.IntegerType())),
    "custom": _schema(id=_S, url=_S, title=_S, text=_S, published_at=_TS, extra=_S),
}


def read_staged(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Staged parquet of one kind of source; columns that a file lacks are null."""
    return spark.read.schema(STAGED[kind]).parquet(path)


def staged(docs: DataFrame, kind: str, prefix: str) -> DataFrame:
    """Documents in the columns of their kind; the id is always prefix and suffix, so no flow writes outside its namespace."""
    have = set(docs.columns)
    full = docs.withColumn("id", F.concat(F.lit(prefix), "suffix"))
    return full.select(*[(F.col(f.name) if f.name in have or f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in STAGED[kind]])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, gzip and bzip2 included, with their file."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, no, value)``: lines with their number in the file; each file is read whole, so numbers can't depend on splits."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("no", "value"))
    return whole.where("value <> ''")


def read_blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Downloaded bodies: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def append_journal(events: DataFrame, path: str) -> None:
    """Events into a journal that is partitioned by month, so that queries over a window read only its months."""
    events.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def read_journal(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    rows = spark.read.parquet(path)
    months = F.col("month").between(F.lit(since[:7]), F.lit(until[:7]))
    return rows.where(months & (F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp"))).drop("month")
