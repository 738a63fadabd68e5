"""Tables written into the folder that driver and executors share, and broadcasts behind a check of their size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast at most, where its rows are a few numbers or a word.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster must set it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvina-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the JVM closes its file system."""
    path = f"{shared_dir(spark)}/corvina-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again, which cuts its lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """df with a number for each row in the order of some columns, gapless from start; rows that tie are told apart anyhow.

    Rows are sorted inside ranges of the order, and a range begins after the counts of those before it, so no task and
    not the driver sees more than a range (the driver: a count for each). The result is a written table.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = staged(ranged.withColumns({"_range": F.spark_partition_id(), "_place": inside}), "numbered")
    base, bases = start, []
    for r in sorted(rows.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        bases.append((r["_range"], base))
        base += r["n"]
    known = df.sparkSession.createDataFrame(bases, "_range int, _base long")
    return rows.join(F.broadcast(known), "_range").withColumn(name, F.col("_base") + F.col("_place")).drop("_range", "_place", "_base")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows that it has few rows; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, most_bytes: int = 20 << 20) -> DataFrame:
    """df dealt evenly over all cores if its files are small: a small file is often one row group, which one task would read.

    Larger tables have row groups enough, and stay as they are: their rows aren't shuffled for it.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most_bytes else df
