"""Vector code compression: codebooks for the parts of vectors, and each vector as one code for each part (product quantisation)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import staged
from corvina.shared import small

#: Vectors of a block: 4096 of 64 components are 2 MB, and the distances to 64 entries as much again.
BLOCK = 4096
#: Components are held within this after scaling, so that squared distances of vectors up to 1,000 components fit in 63 bits.
LARGEST = 1 << 25
#: Salts of a label whose sums are joined back as a table.
SALTS = 32


def _scaled(vector: Column, scale: int) -> Column:
    wide = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.transform(wide, lambda x: F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & (F.size(vector) > 0)


def columns_of(vectors: list, parts: int) -> np.ndarray:
    """(parts, components of a part, vectors): each component of each part lies together."""
    x = np.array(vectors, dtype=np.int64)
    return np.ascontiguousarray(x.T).reshape(parts, -1, len(x))


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, vectors) codes and squared distances; distances are summed one component after the other, ties go to the lower index."""
    codes = np.empty((block.shape[0], block.shape[2]), dtype=np.int64)
    least = np.empty_like(codes)
    for p, (part, book) in enumerate(zip(block, books)):
        d = np.zeros((book.shape[0], block.shape[2]), dtype=np.int64)
        for component, entries in zip(part, book.T):
            off = component[None, :] - entries[:, None]
            d += off * off
        codes[p] = d.argmin(axis=0)
        least[p] = np.take_along_axis(d, codes[p][None, :], axis=0)[0]
    return codes, least


def _round(blocks, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over an RDD of part blocks: sums and counts of each entry, merged through a tree."""
    parts, entries, width = books.shape
    zero = np.zeros((parts, entries, width + 1), dtype=np.int64)

    def add(total: np.ndarray, block: np.ndarray) -> np.ndarray:
        codes, _ = nearest(block, books)
        total = total.copy()
        for p in range(parts):
            np.add.at(total[p, :, :width], codes[p], block[p].T)
            np.add.at(total[p, :, width], codes[p], 1)
        return total

    total = blocks.treeAggregate(zero, add, lambda a, b: a + b, depth=3)
    sums, counts = total[:, :, :width], total[:, :, width:]
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def codebooks_sha256(books: np.ndarray) -> str:
    """Digest of all components by part, entry and place in the part, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """(table, codebooks) of integer vectors floor(scale * x): one code for each of parts equal parts of a vector.

    The table has id_col, code (indexes in part order, two hex digits each), error (the final squared distances summed over
    parts), label_error (error summed over equal labels, nulls together) and codebooks_sha256. The codebooks are (parts,
    entries, components) and start as the parts of the entries smallest ids; each round assigns every part to its nearest
    entry and replaces an entry by the floored mean of its parts.

    Rows become columnar part blocks of BLOCK vectors on the executors; a round is one treeAggregate over them, whose tasks
    send one tensor of parts * entries * (components + 1) whole numbers each, at any number of rows, and whole numbers add
    up to the same in any order. The codebooks alone go to the tasks.

    Edge cases: rows whose vector is null or empty, or holds null or non-finite components, are dropped; so are vectors of
    another length than that of the smallest kept id, which must be a multiple of parts. Fewer than entries rows give fewer
    entries. Rows of one id are coded each, and start entries in the order of their components; null ids come last. A scaled
    component over LARGEST in size counts as LARGEST. An empty table gives no rows and empty codebooks. Other columns are
    ignored.
    """
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries apart at most")
    spark = vectors.sparkSession
    ids = F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label")
    kept = staged(vectors.filter(_usable(F.col(vec_col))).select(*ids, _scaled(F.col(vec_col), scale).alias("q")), "scaled")
    order = F.col("vec_id").asc_nulls_last(), F.col("q")
    width = next((len(r["q"]) for r in kept.orderBy(*order).select("q").limit(1).collect()), 0)
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    kept = kept.filter(F.size("q") == width)
    first = [r["q"] for r in kept.orderBy(*order).select("q").limit(entries).collect()]
    books = columns_of(first, parts).transpose(0, 2, 1) if first else np.zeros((parts, 0, 0), dtype=np.int64)
    if not first:
        empty = spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
        return empty.withColumnRenamed("vec_id", id_col), books

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, x.num_rows, BLOCK):
                q = x.column("q").slice(lo, BLOCK)
                flat = q.flatten().to_numpy(zero_copy_only=False).reshape(len(q), width)
                yield pa.record_batch([pa.array([columns_of(flat, parts).astype("<i4").tobytes()], pa.binary())], names=["block"])

    def opened(row) -> np.ndarray:
        return np.frombuffer(row[0], dtype="<i4").reshape(parts, width // parts, -1).astype(np.int64)

    blocks = kept.select("q").mapInArrow(blocked, "block binary").rdd.map(opened)
    for _ in range(rounds):
        books = _round(blocks, books)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, x.num_rows, BLOCK):
                part = x.slice(lo, BLOCK)
                q = part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                codes, least = nearest(columns_of(q, parts), books)
                text = [c.tobytes().hex() for c in codes.T.astype(np.uint8)]
                columns = part.column("vec_id"), part.column("label"), pa.array(text), pa.array(least.sum(axis=0))
                yield pa.record_batch(list(columns), schema=CODED)

    coded = staged(kept.mapInArrow(assigned, "vec_id long, label long, code string, error long"), "codes")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    sums = salted.groupBy("label").agg(F.sum("error").alias("label_error"), F.collect_set("salt").alias("salts"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode("salts").alias("salt_of"))
    joined = salted.join(small(sums), F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")))
    out = joined.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
    return out, books


def restored(codes: DataFrame, books: np.ndarray, scale: int = 256, id_col: str = "vec_id") -> DataFrame:
    """(id_col, vector): what the codes stand for, (entry + 0.5) / scale in each place."""
    values = (books + 0.5) / scale

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            at = np.frombuffer(bytes.fromhex("".join(x["code"])), dtype=np.uint8).reshape(len(x), -1)
            found = np.concatenate([values[p, at[:, p]] for p in range(at.shape[1])], axis=1)
            yield pd.DataFrame({id_col: x[id_col], "vector": list(found)})

    return codes.select(id_col, "code").mapInPandas(run, f"{id_col} long, vector array<double>")
