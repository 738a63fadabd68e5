"""Topics of documents: spherical k-means over hashed words, in rounds of sums over all documents."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions of a document's vector; words of fewer bytes carry no topic; rows that the first centres are chosen from.
WIDTH, LEAST_BYTES, FIRST = 256, 5, 2000
FAN = 64


def vector(data: bytes) -> np.ndarray:
    """Signed hashed counts of the different words of a text, of length 127 (whole numbers, so that sums are exact)."""
    words = [w for w in set(data.lower().split()) if len(w) >= LEAST_BYTES]
    h = np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words))
    sign = ((h >> np.uint32(16)) & np.uint32(1)).astype(np.float64) * 2 - 1
    v = np.bincount(h % np.uint32(WIDTH), sign, WIDTH)
    return np.rint(127 * v / max(1e-9, np.linalg.norm(v))).astype(np.int8)


def nearest(vectors: np.ndarray, mean: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of the greatest cosine with each vector, once the mean of all vectors is taken off; ties to the first."""
    v = vectors - mean
    v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    return np.round(v @ centres.T, 6).argmax(axis=1)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(-1, WIDTH).astype(np.float64)


SUMS = pa.schema([("k", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("total", pa.binary())])
SUMS_SQL = "k int, part long, n long, total binary"


def _sums(vectors: DataFrame, mean: np.ndarray | None, centres: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of each centre, sum of their vectors); without centres those of all rows. Whole numbers in any order."""
    many = 1 if centres is None else len(centres)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(many, dtype=np.int64), np.zeros((many, WIDTH), dtype=np.int64)
        for x in batches:
            if x.num_rows:
                v = _matrix(x.column("vector"))
                k = np.zeros(len(v), dtype=np.int64) if centres is None else nearest(v, mean, centres)
                n += np.bincount(k, minlength=many)
                np.add.at(total, k, v.astype(np.int64))
        rows = [pa.array(range(many), pa.int32()), pa.array([int(n.sum()) % FAN] * many, pa.int64()), pa.array(n), pa.array([t.tobytes() for t in total])]
        yield pa.RecordBatch.from_arrays(rows, schema=SUMS)

    def merge(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b, dtype=np.int64) for b in t.column("total").to_pylist()], axis=0)
        return pa.table([t.column("k")[:1], t.column("part")[:1], pa.array([sum(t.column("n").to_pylist())], pa.int64()), pa.array([total.tobytes()])], schema=SUMS)

    parts = vectors.select("vector").mapInArrow(add, SUMS_SQL).groupBy("k", "part").applyInArrow(merge, SUMS_SQL)
    n, total = np.zeros(many, dtype=np.int64), np.zeros((many, WIDTH), dtype=np.int64)
    for r in parts.collect():  # FAN rows a centre at most
        n[r["k"]] += r["n"]
        total[r["k"]] += np.frombuffer(bytes(r["total"]), dtype=np.int64)
    return n, total


def learn(vectors: DataFrame, k: int = 12, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, centres) of a table with columns vector (bytes) and id. The first centres are far from one another among FIRST
    rows of the least hashes; each round assigns all rows and moves every centre to the mean of its own."""
    n, total = _sums(vectors, None, None)
    mean = total[0] / max(1, n[0])
    first = vectors.select("vector", F.xxhash64("vector").alias("h")).distinct().orderBy("h").limit(FIRST)
    v = np.array([np.frombuffer(bytes(r["vector"]), dtype=np.int8) for r in first.collect()], dtype=np.float64).reshape(-1, WIDTH) - mean
    v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    chosen = v[:1]
    while 0 < len(chosen) < min(k, len(v)):
        chosen = np.concatenate([chosen, v[[(v @ chosen.T).max(axis=1).argmin()]]])
    centres = chosen if len(chosen) else np.zeros((1, WIDTH))
    for _ in range(rounds if len(chosen) > 1 else 0):
        n, total = _sums(vectors, mean, centres)
        moved = total / np.maximum(1, n)[:, None] - mean
        moved /= np.maximum(1e-9, np.linalg.norm(moved, axis=1, keepdims=True))
        centres = np.where(n[:, None] > 0, moved, centres)
    return mean, centres
