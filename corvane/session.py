"""Session defaults, scratch tables in shared storage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "corvane", **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects; a cluster sets the same keys in its own configuration."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | conf
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Tables whose rows cost much work each.
HEAVY = {"documents", "ingest_docs", "crawl_pages"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a folder. One with costly rows that comes in fewer pieces than there are cores (a single row group, say)
    is spread over the cores first; a large table has more pieces and is left as it is."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in HEAVY and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests, one machine) a temporary folder is made once and set."""
    where = spark.conf.get("spark.checkpoint.dir", "")
    if not where:
        where = spark.sparkContext.getCheckpointDir() or ""
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever storage the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever storage the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written to shared storage to cut lineage: they survive the loss of an executor, unlike cached blocks.

    ``keep`` writes a DataFrame as parquet and returns the reader over it; ``drop`` deletes what is no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables behind frames returned by ``keep``, or the whole folder when none is given."""
        paths = {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()} if frames else {self.base}
        for p in paths:
            if p.startswith(self.base) or self.base.split("://")[-1] in p:
                remove(self.spark, p)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether a DataFrame has no more than so many rows; reads no further than it must."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the size is proven to be at most ``rows``; otherwise Spark picks a shuffle join."""
    return F.broadcast(df) if at_most(df, rows) else df


def bounded_rows(df: DataFrame, rows: int, what: str) -> list:
    """Rows of a table that is small by its nature (sources, samples); refuses to collect more than the stated bound."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"{what}: more than {rows} rows, which is the documented bound")
    return got


def least_hashed(df: DataFrame, key: Column, n: int) -> DataFrame:
    """About n rows, those with the least hash of ``key``. Tasks send n hashes to find the cut, never whole rows."""
    low = df.select(key.alias("h")).orderBy("h").limit(n).collect()
    return df.where(key <= low[-1]["h"]).limit(n) if low else df.limit(0)


def squeeze(text: Column) -> Column:
    """Lower case, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), WHITE, " "))


#: Fixed value: every character that counts as white space.
WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
