"""A keyed table in hash buckets under versioned manifests: upserts rewrite the touched buckets, readers never see half a write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str):
    """(FileSystem, Path class) of the store that path is in."""
    jvm = spark.sparkContext._jvm
    of = jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    fs, of = files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(of(path))) if fs.exists(of(path)) else []


def put_once(spark: SparkSession, path: str, content: dict) -> None:
    """Write a small file that appears whole or not at all; FileExistsError if somebody else has written it before."""
    fs, of = files(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    draft = of(f"{path}.{jvm.java.util.UUID.randomUUID()}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, of(path), none)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" not in str(e):
            raise
        raise FileExistsError(path) from None


def got(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def removed(spark: SparkSession, path: str) -> None:
    fs, of = files(spark, path)
    fs.delete(of(path), True)


class Store:
    """Rows by key under path.

    data/v=N/bucket=B holds what version N wrote of bucket B; manifest/N.json names, for each bucket, the version whose files
    hold its rows. A writer writes new folders first and then its manifest, which must be the next number: a killed writer
    leaves folders that no manifest names, and of two writers at once one gets FileExistsError and may try again. Readers take
    the last manifest (or an older one) and are not disturbed by writers. A bucket's rows are dealt to files tasks, so a bucket may be large.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, files_per_bucket: int = 1):
        self.spark, self.path, self.key, self.files = spark, path.rstrip("/"), key, files_per_bucket
        before = self._manifest(self.version())
        self.buckets = before["buckets"] if before else buckets
        if before and before["key"] != key:
            raise ValueError(f"the store's key is {before['key']}")

    def version(self) -> int:
        """The last version; 0 before the first write."""
        return max((int(n.removesuffix(".json")) for n in listed(self.spark, f"{self.path}/manifest") if n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict | None:
        return got(self.spark, f"{self.path}/manifest/{version:08d}.json") if version else None

    def bucket(self, column: str | None = None):
        return F.pmod(F.xxhash64(F.col(column or self.key)), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the last if not given, of all or of some buckets."""
        m = self._manifest(self.version() if version is None else version)
        if m is None:
            raise ValueError(f"{self.path} has no version yet")
        schema = StructType.fromJson(m["schema"])
        wanted = {b: v for b, v in m["parts"].items() if buckets is None or int(b) in buckets}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in wanted.items()]
        return self.spark.read.schema(schema).parquet(*paths)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is in keys (one column of that name); only their buckets are read."""
        asked = keys.select(self.key).distinct()
        return self.read(buckets=self._touched(asked)).join(asked, self.key, "left_semi")

    def upsert(self, rows: DataFrame, order: str | None = None, note: dict | None = None) -> int:
        """Rows replace those of equal keys, others are added; the new version.

        Of rows of one key the one with the greatest order wins (ties, and without order: the greatest hash of the row). A null
        key is a key like any other. Only buckets that rows has keys of are read and written.
        """
        return self._write(rows, order, "upsert", note)

    def insert(self, rows: DataFrame, order: str | None = None, note: dict | None = None) -> int:
        """As upsert, but rows of keys that are there already stay as they are."""
        return self._write(rows, order, "insert", note)

    def delete(self, keys: DataFrame, note: dict | None = None) -> int:
        return self._write(keys.select(self.key), None, "delete", note)

    def note(self) -> dict:
        """What the last writer noted."""
        m = self._manifest(self.version())
        return (m or {}).get("note") or {}

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # as many as there are buckets at most

    def _write(self, rows: DataFrame, order: str | None, how: str, note: dict | None) -> int:
        now = self.version()
        m = self._manifest(now) or {"parts": {}, "schema": None, "note": None}
        touched = self._touched(rows)
        if how == "delete":
            if not now:
                return now
            rows = rows.distinct()
        else:
            given = [c for c in rows.columns]
            mark = F.struct(*([F.col(order)] if order else []), F.xxhash64(*given))
            rows = rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*given), mark).alias("_row")).select("_row.*")
        if now:
            old = self.read(now, touched)
            if how == "insert":
                rows = rows.join(old.select(F.col(self.key).alias("_old")), F.col(self.key).eqNullSafe(F.col("_old")), "left_anti")
                rows = old.unionByName(rows, allowMissingColumns=True)
            else:
                keys = rows.select(F.col(self.key).alias("_new"))
                left = old.join(keys, F.col(self.key).eqNullSafe(F.col("_new")), "left_anti")
                rows = left if how == "delete" else left.unionByName(rows, allowMissingColumns=True)
        new, salt = now + 1, F.pmod(F.xxhash64(F.lit("file"), F.col(self.key)), F.lit(self.files))
        dealt = rows.withColumn("bucket", self.bucket()).repartition(F.col("bucket"), salt)
        attempt = f"{self.path}/data/v={new}"
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(attempt)
        parts = {b: v for b, v in m["parts"].items() if int(b) not in touched}
        parts |= {n.removeprefix("bucket="): new for n in listed(self.spark, attempt) if n.startswith("bucket=")}
        schema = json.loads(rows.schema.json())
        content = {"version": new, "key": self.key, "buckets": self.buckets, "schema": schema, "parts": parts, "note": note if note is not None else m["note"], "how": how}
        put_once(self.spark, f"{self.path}/manifest/{new:08d}.json", content)
        return new

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove manifests but the last keep ones, and folders that no kept manifest names; what was removed."""
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1)]
        named = {(str(v), b) for k in kept for b, v in self._manifest(k)["parts"].items()}
        gone = []
        for n in listed(self.spark, f"{self.path}/manifest"):
            if not n.endswith(".json") or int(n.removesuffix(".json")) < kept[0]:
                gone.append(f"{self.path}/manifest/{n}")
        for v in listed(self.spark, f"{self.path}/data"):
            for b in listed(self.spark, f"{self.path}/data/{v}"):
                if b.startswith("bucket=") and (v.removeprefix("v="), b.removeprefix("bucket=")) not in named and int(v.removeprefix("v=")) <= last:
                    gone.append(f"{self.path}/data/{v}/{b}")
        for path in gone:
            removed(self.spark, path)
        return gone
