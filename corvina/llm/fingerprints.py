"""Document fingerprints: 256-bit SimHash of weighted terms, likeness to edited and to next texts, search by block tables."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import partitions, staged
from corvina.llm.simhash import block_permutations, hamming, likeness, weighted_votes

WIDTH = 32  # bytes of a fingerprint
#: A term is a word, or a pair of neighbouring words, which tells texts of one vocabulary apart and so weighs more.
WORD_WEIGHT, PAIR_WEIGHT = 0.25, 1.0
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads each input bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def terms(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the different terms of a text and their weights: sublinear in how often they occur.

    Weights are whole numbers, so that votes are exact and don't depend on what else is in a batch.
    """
    tokens = data.lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    number = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), dtype=np.uint64, count=len(number))
    at = np.fromiter(map(number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    pairs, times = np.unique(at[:-1] * len(number) + at[1:], return_counts=True)
    first, second = own[pairs // len(number)], own[pairs % len(number)]
    hashes = np.concatenate([own, _mixed(first * _MIX[0] + second)])
    weights = np.concatenate([
        WORD_WEIGHT * np.log1p(np.bincount(at, minlength=len(number))), PAIR_WEIGHT * np.log1p(times)
    ])
    return hashes, np.rint(1024 * weights)


def fingerprint_batch(texts: list[bytes]) -> np.ndarray:
    """One row of WIDTH bytes for each text; a text without words has all zeros."""
    parts = [terms(t) for t in texts]
    sizes = [len(h) for h, _ in parts]
    owners = np.repeat(np.arange(len(texts)), sizes)
    seeds = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, dtype=np.uint64)
    weights = np.concatenate([w for _, w in parts]) if parts else np.zeros(0)
    words = np.stack([_mixed(seeds + np.uint64(k * int(_MIX[0]) % (1 << 64))) for k in range(WIDTH // 8)], axis=1)
    votes = weighted_votes(words.view(np.uint8).reshape(len(seeds), WIDTH), weights, owners, len(texts))
    return np.packbits(votes > 0, axis=1)


def _edit(text: str, after: str) -> str:
    cut = len(text) // 2
    return text[: len(text) - cut] + after[:cut]


def _rows(ids: list[int], texts: list[str], nexts: list[str]) -> dict[str, list]:
    edited = [_edit(a, b) for a, b in zip(texts, nexts)]
    sha, marks, changed_marks, near = [], [], [], []
    for lo in range(0, len(ids), 256):
        raw = [[t.encode() for t in x[lo : lo + 256]] for x in (texts, edited, nexts)]
        own, changed, after = (fingerprint_batch(x) for x in raw)
        sha += [hashlib.sha256(t).hexdigest() for t in raw[1]]
        marks += [f.tobytes().hex() for f in own]
        changed_marks += [f.tobytes().hex() for f in changed]
        near.append(np.stack([hamming(own, changed), hamming(own, after)]))
    likely = likeness(np.concatenate(near, axis=1), 8 * WIDTH)
    return {
        "id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": sha,
        "fingerprint": marks,
        "edited_fingerprint": changed_marks,
        "near_edited": likely[0].tolist(),
        "near_next": likely[1].tolist(),
    }


#: Digest rows have kind 1; the first and the last row of a task are kept with their texts as kinds 0 and 2.
ARROW = pa.schema([
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("kind", pa.int32()), ("text", pa.string()), ("task", pa.int32()),
])
SCHEMA = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, kind int, text string, task int"
)
NAMES = ARROW.names[:7]


def _batch(kind: int, columns: dict[str, list], task: int | None = None) -> pa.RecordBatch:
    n = len(columns["id"])
    fixed = {"kind": [kind] * n, "task": [task] * n}
    return pa.RecordBatch.from_arrays([pa.array(fixed.get(f.name) or columns.get(f.name, [None] * n), f.type) for f in ARROW], schema=ARROW)


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit with the next text, and how like they are.

    Rows are dealt out by ranges of the id (and of a hash of the text, so that rows of one id are dealt out too) and sorted
    there, so a row's next one is below it in the same task; texts cross the network once. The last row of a task needs the
    first of the next task with rows: these two rows a task are kept with their texts and joined by the task's number; the
    order of the numbers is the only thing that one task sorts, one whole number for each task.

    Edge cases: a null text is an empty one (fingerprint zero; like another empty one by 1); a row that is alone is its own
    next one; rows with equal ids follow each other by a hash of their text; rows with a null id come after all others, so
    the last id's next row is one of them; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    src = df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_last(), F.col("h")]
    dealt = src.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text")
    dealt = dealt.select("id", "text", F.spark_partition_id().alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, str] | None = None
        task = 0
        for x in batches:
            ids, texts = x.column("id").to_pylist(), x.column("text").to_pylist()
            if not ids:
                continue
            task = x.column("task")[0].as_py()
            if held is None:
                yield _batch(0, {"id": ids[:1], "text": texts[:1]}, task)
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            if len(ids) > 1:
                yield _batch(1, _rows(ids[:-1], texts[:-1], texts[1:]), task)
            held = ids[-1], texts[-1]
        if held is not None:
            yield _batch(2, {"id": [held[0]], "text": [held[1]]}, task)

    made = staged(dealt.mapInArrow(run, SCHEMA), "fingerprints")
    tasks = made.filter("kind = 0").select("task")
    everywhere = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chain = tasks.select("task", F.coalesce(F.lead("task").over(Window.orderBy("task")), F.first("task").over(everywhere)).alias("following"))
    first = made.filter("kind = 0").select(F.col("task").alias("following"), F.col("text").alias("after"))
    last = made.filter("kind = 2").select("task", "id", "text").join(chain, "task").join(first, "following").select("id", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield _batch(1, _rows(*(x.column(c).to_pylist() for c in ("id", "text", "after"))))

    whole = made.filter("kind = 1").select(*NAMES).unionByName(last.mapInArrow(close, SCHEMA).select(*NAMES))
    return whole.withColumnRenamed("id", id_col)


def fingerprinted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, blocks: int = 4) -> DataFrame:
    """edited_likeness() with the neighbours of each row's fingerprint among all rows: n_near, the number of other
    fingerprints within radius bits of it, and near_id, the smallest id of a row within radius bits (itself included).

    Equal fingerprints are one, so copies are neither joined nor paired. Edge cases as there; a null id is never the
    smallest (near_id is null where all are null).
    """
    rows = staged(edited_likeness(df, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")), "marked")
    nodes = staged(rows.groupBy("fingerprint").agg(F.min(id_col).alias("first_id"), F.collect_set("salt").alias("salts")), "marks")
    found = neighbours(nodes.select("fingerprint", "first_id"), radius, blocks)
    of = nodes.join(found, "fingerprint", "left").select(
        "fingerprint",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.least("first_id", "least_id").alias("near_id"),
        F.explode("salts").alias("salt"),
    )
    return rows.join(of, ["fingerprint", "salt"]).select(id_col, *NAMES[1:], "n_near", "near_id")


#: Salts of a fingerprint's rows; fingerprints of one lead that are compared in one unit, at most twice so many.
SALTS, CELL = 32, 2048


def _keyed(df: DataFrame, tables: list[list[int]], carried: str = "") -> DataFrame:
    """A row for each fingerprint (hex of WIDTH bytes) and table: mark (bytes), t, lead (hash of the table's leading blocks)."""

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            raw = b"".join(bytes.fromhex(f) for f in x.column("fingerprint").to_pylist())
            mark = pa.array([raw[i : i + WIDTH] for i in range(0, len(raw), WIDTH)], pa.binary())
            bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, WIDTH), axis=1)
            for k, order in enumerate(tables):
                keys = np.packbits(bits[:, order], axis=1)
                lead = np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), k) for r in keys), dtype=np.uint64, count=len(keys))
                rest = [x.column(c) for c in x.schema.names if c != "fingerprint"]
                names = ["mark", "t", "lead", *(c for c in x.schema.names if c != "fingerprint")]
                yield pa.RecordBatch.from_arrays([mark, pa.array(np.full(len(mark), k, np.int32)), pa.array(lead.view(np.int64)), *rest], names=names)

    return df.mapInArrow(leads, "mark binary, t int, lead long" + carried)


def _first_table(diff: np.ndarray, tables: list[list[int]]) -> np.ndarray:
    """For rows of differing bits: the first table on whose leading blocks the two agree."""
    first = np.full(len(diff), len(tables))
    for k in reversed(range(len(tables))):
        first[~diff[:, tables[k]].any(axis=1)] = k
    return first


def neighbours(marks: DataFrame, radius: int, blocks: int, cell: int = CELL) -> DataFrame:
    """(fingerprint, n_near, least_id): how many other fingerprints lie within radius bits, and the least first_id of those.

    marks: (fingerprint, first_id), each fingerprint once. The bits are cut into blocks; each table leads with blocks - radius
    of them, and two fingerprints within the radius agree on the lead of one table at least; a pair counts in the first one.
    Leads of more than cell fingerprints are dealt into cells, and each pair of cells is a unit of its own. Units are
    compared where they lie, and only a count and an id for each fingerprint leave the task, so no pairs are written.
    """
    tables = block_permutations(8 * WIDTH, radius, blocks)
    keyed = staged(_keyed(marks.filter("fingerprint is not null"), tables, ", first_id long"), "leads")
    salt = F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int")
    sizes = keyed.groupBy("t", "lead").agg(F.count("*").alias("n"), F.collect_set(salt).alias("salts")).filter("n > 1")
    sizes = sizes.select("t", "lead", F.ceil(F.col("n") / cell).cast("int").alias("cells"), F.explode("salts").alias("salt"))
    met = keyed.withColumn("salt", salt).join(sizes, ["t", "lead", "salt"])
    met = met.withColumn("c", F.pmod(F.xxhash64(F.lit(3), "mark"), F.col("cells")).cast("int"))
    met = met.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    units = met.select("t", "lead", F.least("c", "y").alias("u"), F.greatest("c", "y").alias("v"), "c", "mark", "first_id")
    keys = ["t", "lead", "u", "v"]
    dealt = units.repartition(partitions(marks.sparkSession), *keys).sortWithinPartitions(*keys, "c")

    def compare(t: int, c: np.ndarray, bits: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, least = np.zeros(len(c), dtype=np.int64), np.full(len(c), np.iinfo(np.int64).max)
        for lo in range(0, len(c), 256):
            part = bits[lo : lo + 256, None, :] ^ bits[None, :, :]
            ok = np.bitwise_count(part).sum(axis=2, dtype=np.int64) <= radius
            a, b = np.nonzero(ok)
            a = a + lo
            # within one cell all pairs count; between two only those across
            keep = (a != b) & ((c[a] != c[b]) | (c[0] == c[-1]))
            a, b = a[keep], b[keep]
            diff = np.unpackbits((bits[a] ^ bits[b]).view(np.uint8), axis=1)
            keep = _first_table(diff, tables) == t
            a, b = a[keep], b[keep]
            near += np.bincount(a, minlength=len(c))
            np.minimum.at(least, a, ids[b])
        return near, least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in itertools.chain(batches, [None]):
            if x is not None:
                table = pa.Table.from_batches([x])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or not held.num_rows:
                continue
            key = np.stack([held.column(k).to_numpy() for k in keys], axis=1)
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            ends = np.append(cut[1:], len(key))
            if x is not None:  # the last unit may go on in the next batch
                cut, ends = cut[:-1], ends[:-1]
            if not len(cut):
                continue
            n = int(ends[-1])
            raw = b"".join(held.column("mark")[:n].to_pylist())
            bits = np.frombuffer(raw, dtype=np.uint64).reshape(-1, WIDTH // 8)
            ids = held.column("first_id")[:n].fill_null(np.iinfo(np.int64).max).to_numpy()
            c = held.column("c").to_numpy()
            near, least = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for a, b in zip(cut.tolist(), ends.tolist()):
                near[a:b], least[a:b] = compare(int(key[a, 0]), c[a:b], bits[a:b], ids[a:b])
            at = np.flatnonzero(near)
            names = [raw[WIDTH * i : WIDTH * (i + 1)].hex() for i in at.tolist()]
            least = [None if v == np.iinfo(np.int64).max else v for v in least[at].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(near[at]), pa.array(least, pa.int64())], names=["fingerprint", "n_near", "least_id"]
            )
            held = held.slice(n)

    counted = dealt.mapInArrow(run, "fingerprint string, n_near long, least_id long")
    return counted.groupBy("fingerprint").agg(F.sum("n_near").alias("n_near"), F.min("least_id").alias("least_id"))


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """All index fingerprints within radius bits of each query: (query, fingerprint, distance), for different fingerprints.

    queries and index have a column fingerprint (hex of WIDTH bytes). Rows meet by the hash of table and lead, as in
    neighbours(), whose answer is a count; here the pairs themselves are asked for, so the result is as long as they are
    many. Equal fingerprints are one row here: join the result to membership for the documents. Null fingerprints match
    nothing.
    """
    tables = block_permutations(8 * WIDTH, radius, blocks)
    keyed = [_keyed(d.select("fingerprint").filter("fingerprint is not null").distinct(), tables) for d in (queries, index)]
    met = keyed[0].withColumnRenamed("mark", "query").join(keyed[1], ["t", "lead"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if x.empty:
                continue
            a, b = (np.frombuffer(b"".join(x[c]), dtype=np.uint8).reshape(-1, WIDTH) for c in ("query", "mark"))
            d = hamming(a, b)
            keep = (d <= radius) & (_first_table(np.unpackbits(a ^ b, axis=1), tables) == x["t"].to_numpy())
            names = {c: [bytes(v).hex() for v in x[c][keep]] for c in ("query", "mark")}
            yield pd.DataFrame({"query": names["query"], "fingerprint": names["mark"], "distance": d[keep]})

    return met.mapInPandas(measure, "query string, fingerprint string, distance int")
