"""Reindexing in batches that commit one by one, and streams whose batches commit once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators import lexical
from corvina.sources.store import Store, got, listed, put_once, removed


class Incomplete(RuntimeError):
    """The index lacks rows; running again goes on where it stopped."""


def _sum(key: str):
    """Count and order-free checksum of a key column."""
    return F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(key).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("check")


class Reindex:
    """An index of fragments under path, built by batches.

    A row's batch is a hash of its key, so every run deals alike. Batch b is written to vectors/batch=b/<attempt> and then
    committed by log/<b>.json, which names the attempt with its count and checksum; folders that no entry names are what
    killed runs left, and go before the next run. When all batches are committed and their counts are verified, the lexical
    index is built into lexical/<attempt>, and current/<n>.json names everything: readers see the old index until that moment.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "fragment_id", batches: int = 16, settings: dict[str, str] | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        contract = {"key": key, "batches": batches, "settings": {k: str(v) for k, v in (settings or {}).items()}}
        if listed(spark, f"{self.path}/contract"):
            before = got(spark, f"{self.path}/contract/contract.json")
            wrong = [f"{k}: the index has {before[k]!r}, asked for {v!r}" for k, v in contract.items() if before[k] != v]
            if wrong:
                raise ValueError("; ".join(wrong))
        else:
            put_once(spark, f"{self.path}/contract/contract.json", contract)
        self.batches = batches

    def committed(self) -> dict[int, dict]:
        return {int(n.removesuffix(".json")): got(self.spark, f"{self.path}/log/{n}") for n in listed(self.spark, f"{self.path}/log") if n.endswith(".json")}

    def clean(self) -> list[str]:
        """Remove what no log entry and no current index names; what was removed."""
        kept = {(b, e["attempt"]) for b, e in self.committed().items()}
        gone = []
        for folder in listed(self.spark, f"{self.path}/vectors"):
            b = int(folder.removeprefix("batch="))
            gone += [f"{self.path}/vectors/{folder}/{a}" for a in listed(self.spark, f"{self.path}/vectors/{folder}") if (b, a) not in kept]
        now = self.current()
        gone += [f"{self.path}/lexical/{a}" for a in listed(self.spark, f"{self.path}/lexical") if now is None or a != now["lexical"]]
        for p in gone:
            removed(self.spark, p)
        return gone

    def current(self) -> dict | None:
        names = [n for n in listed(self.spark, f"{self.path}/current") if n.endswith(".json")]
        return got(self.spark, f"{self.path}/current/{names[-1]}") if names else None

    def run(self, fragments: DataFrame, encode: Callable[[DataFrame], DataFrame], text_col: str = "text", most: int | None = None, extend: bool = True) -> dict:
        """Index fragments (key, text, ...); encode adds the vector columns to a batch. The current index.

        Committed batches whose rows are still the wanted ones are skipped; with extend a batch that lacks rows gets only those
        encoded. Rows that the corpus no longer has raise ValueError before anything is written. most: batches of this run at
        most (the rest stays for the next one, and Incomplete is raised).
        """
        of = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.batches)).cast("int")
        wanted = {r["b"]: r for r in fragments.groupBy(of.alias("b")).agg(*_sum(self.key)).collect()}  # a row for each batch
        done = self.committed()
        stale = [b for b, e in done.items() if b not in wanted or (e["n"], e["check"]) != (wanted[b]["n"], wanted[b]["check"])]
        gone = [b for b in stale if self._read(b, done[b]).join(fragments.select(self.key), self.key, "left_anti").limit(1).count()]
        if gone or (stale and not extend):
            raise ValueError(f"batches {gone or stale} hold rows that the corpus no longer has" if gone else f"batches {stale} lack rows")
        self.clean()
        todo = sorted(b for b in wanted if b not in done or b in stale)
        for b in todo[:most]:
            part = fragments.filter(of == b)
            attempt = uuid.uuid4().hex
            old = self._read(b, done[b]) if b in done else None
            rows = encode(part if old is None else part.join(old.select(self.key), self.key, "left_anti"))
            rows = rows if old is None else old.unionByName(rows)
            rows.write.parquet(f"{self.path}/vectors/batch={b}/{attempt}")
            n, check = self.spark.read.parquet(f"{self.path}/vectors/batch={b}/{attempt}").agg(*_sum(self.key)).first()
            if (n, check) != (wanted[b]["n"], wanted[b]["check"]):
                raise Incomplete(f"batch {b} has {n} rows of {wanted[b]['n']}, or others than asked for")
            if b in done:
                removed(self.spark, f"{self.path}/log/{b:06d}.json")
            put_once(self.spark, f"{self.path}/log/{b:06d}.json", {"attempt": attempt, "n": n, "check": check})
        done = self.committed()
        left = [b for b in wanted if b not in done]
        total, expected = sum(e["n"] for e in done.values()), sum(r["n"] for r in wanted.values())
        if left or total < expected or len(todo[:most]) < len(todo):
            raise Incomplete(f"{total} of {expected} rows are indexed; run again to go on")
        now = self.current()
        if now is not None and not todo and now["n"] == total:
            return now
        attempt = uuid.uuid4().hex
        lexical.write_index(fragments, f"{self.path}/lexical/{attempt}", self.key, text_col)
        number = 0 if now is None else now["number"] + 1
        put_once(self.spark, f"{self.path}/current/{number:08d}.json", {"number": number, "n": total, "lexical": attempt, "vectors": {str(b): e["attempt"] for b, e in done.items()}})
        return self.current()

    def _read(self, b: int, entry: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors/batch={b}/{entry['attempt']}")

    def vectors(self) -> DataFrame:
        """The rows of the current index."""
        now = self.current()
        return self.spark.read.parquet(*[f"{self.path}/vectors/batch={b}/{a}" for b, a in now["vectors"].items()])

    def lexical_path(self) -> str:
        return f"{self.path}/lexical/{self.current()['lexical']}"


def ingest(stream: DataFrame, store: Store, checkpoint: str, order: str | None = None, how: str = "insert") -> None:
    """Drain a stream into a store: each micro-batch is one version, whose manifest notes the batch.

    Only the buckets that a batch has keys of are read. A batch that a killed run has committed, but whose end the checkpoint
    doesn't know, is met again with the same number and skipped.
    """

    def write(batch: DataFrame, number: int) -> None:
        target = Store(batch.sparkSession, store.path, store.key, store.buckets, store.files)
        if target.note().get("stream", -1) < number:
            getattr(target, how)(batch, order, {"stream": number})

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
