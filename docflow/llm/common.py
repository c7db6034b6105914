"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_WRITTEN: list[str] = []


#: Bytes of a batch of rows on its way to or from Python. Spark's own bound is eight times as much, twice for each task.
BATCH_BYTES = 8 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "64m")


def bound_batches(spark: SparkSession) -> None:
    """Sets BATCH_BYTES for the session, unless it has a bound of its own; rows of long texts so stay few at a time."""
    if spark.conf.get(_BATCH, _BATCH_DEFAULT[0]) in _BATCH_DEFAULT:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session (tests) may go without."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="docflow-"))
    return _OWN_DIR[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def write_read(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors, and gives later joins a true size."""
    spark = df.sparkSession
    bound_batches(spark)
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The paths that this process has made in the shared folder and not deleted."""
    return list(_WRITTEN)


def drop_written(spark: SparkSession, before: list[str], keep: DataFrame) -> None:
    """Deletes what was written since written() gave before, except what keep reads. Other results that rest on it must have been consumed."""
    held = keep.inputFiles()
    for path in set(_WRITTEN) - set(before):
        if not any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in held):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _WRITTEN.remove(path)


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files under a table that write_read() returned, by Spark's own statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hash_sample(df: DataFrame, by: list[Column], rows: int, value: Column) -> list:
    """value of about rows different rows (told apart by a hash of by), at most twice as many, drawn from the whole table by that hash: alike in every run.

    A table of fewer rows is given whole. Where copies are so many that the hash picks nothing, those of the smallest
    hashes come instead, so only an empty table has no sample.
    """
    often = max(1, df.count() // rows)
    hashed = df.select(F.xxhash64(*by).alias("h"), value.alias("v"))
    picked = hashed.where(F.pmod("h", F.lit(often)) == 0).dropDuplicates(["h"]).limit(2 * rows).collect()
    return [r.v for r in picked or hashed.orderBy("h").limit(rows).dropDuplicates(["h"]).collect()]


def ranked(df: DataFrame, key: str, order: list[Column | str], name: str) -> DataFrame:
    """df plus rank, its row's place (from 0) among the rows of its key in the given order, and n, the rows of that key. key is never null.

    The rows are dealt by ranges of key and order, sorted and written with a running number, so a key of any size is spread
    over many tasks. What is summed over a key afterwards has one row for each range that the key lies in.
    """
    placed = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = write_read(placed, f"{name}_placed").withColumn("_range", F.shiftright("_at", 33))
    spans = placed.groupBy("_range", key).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("_range", key, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(W.partitionBy(key)).alias("n"))
    return placed.join(write_read(spans, f"{name}_spans"), ["_range", key]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
