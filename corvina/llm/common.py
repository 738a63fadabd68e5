"""What the operators share: the shared folder, staged tables, salted joins, word splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.shared import shared_dir

#: Fixed value: the white space that separates words, [\x20\x09-\x0D].
WHITESPACE = " \t\n\x0b\x0c\r"
WHITESPACE_RE = "[\\x20\\x09-\\x0D]+"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    It cuts the lineage like checkpoint(), but stays columnar and compressed; a lost executor costs nothing.
    The folder is removed when the JVM closes its file system.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvina-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    except Exception as e:  # a session without a gateway keeps its folder; it says so
        print(f"corvina: {path} stays until it is removed by hand ({type(e).__name__})")
    return spark.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Remove the folder of a table that staged() gave and nothing reads any more."""
    spark = df.sparkSession
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: What operators of this process remember between tasks (a tokenizer and its words), by operator.
_REMEMBERED: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    return _REMEMBERED.setdefault(operator, {})


def forget() -> None:
    """Let go of what operators have remembered in this worker: stages follow one another, and a later one needs the memory."""
    for held in _REMEMBERED.values():
        held.clear()


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body names it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITESPACE_RE))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
