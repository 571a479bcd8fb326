"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a session on one machine (local master, as in tests) gets a temporary
    folder, which is then set; on a cluster executors would write where the driver can't read, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="foliomatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def removed(spark: SparkSession) -> None:
    """Delete the session's intermediates, once no table made from them is read any more: at the end of a job or between queries."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate once to the shared folder and read it back.

    This cuts the lineage without tying rows to an executor: a lost executor costs nothing that was
    written, and several later reads don't repeat the work that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A side of a join is broadcast only if it was counted and has at most this many rows.
BROADCAST_ROWS = 100_000
#: As many of a few numbers or ids each, some 50 MB, where the other side has texts or words, which would be shuffled instead.
NARROW_ROWS = 500_000


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it was counted and has few enough rows; else joins are Spark's choice."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


#: Rows from which a table of words is large.
LARGE_ROWS = 20_000


def large(df: DataFrame) -> DataFrame:
    """A table that joins must not broadcast, however small its files are.

    Spark takes a stored table's size from its compressed files. Words and indexes are ten to thirty times that in memory, so
    tables judged to be below the limit of automatic broadcasts can fill the driver. Sort-merge joins hold at any size."""
    return df.hint("merge")


def kept_large(df: DataFrame, name: str) -> DataFrame:
    """``written``; a large table if it has more than ``LARGE_ROWS`` rows, which are counted from its files' footers."""
    out = written(df, name)
    return large(out) if out.count() > LARGE_ROWS else out


#: Bytes of text in a part, whose words' rows are some twenty times that.
PART_BYTES = 3 << 20


def dealt(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents dealt out by key, in parts of about ``PART_BYTES`` of text however many there are.

    Parts left to Spark are cut by the size of compressed texts, of which one holds gigabytes of words' rows: sorting them spills more
    the larger the table. These parts' rows fit a task's memory, and a part that holds one large document holds little else."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = -(-size // PART_BYTES)
    # a little text is left to Spark, which may then take fewer parts
    return docs.repartition(parts, key) if parts > docs.sparkSession.sparkContext.defaultParallelism else docs.repartition(key)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly if the source has fewer partitions than the session has cores, as a single small file
    has; any larger source stays as it is read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
