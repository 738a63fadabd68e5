"""Removal of byte strings that also start in an earlier document, by externally sorted suffixes."""

from __future__ import annotations

import gc
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import partitions, staged, unstaged
from corvina.llm.induced import sorted_suffixes

#: An anchor is the hash of this many bytes; every window of the match length has one, its least hash.
ANCHOR = 20
SALTS = 4
COPIES = -1  # in place of a salt: the documents of this row are copies of others
#: Bytes of text that an anchor bucket, or a shard of suffixes, stands for on average.
BUCKET_BYTES = 8 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64((1 << 24) - 1)
# The primes of XXH64.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def _freed(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """staged(); then the staged tables in used go, and Spark may drop the shuffle files of the steps before."""
    out = staged(df, name)
    for x in used:
        unstaged(x)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash) of the runs of window starts that share their anchor, the leftmost least hash in the window."""
    n, w = len(data), length - ANCHOR + 1
    if n < length:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.uint64)
    padded = np.frombuffer(data + bytes(16), dtype=np.uint8)
    words = np.ndarray((n,), dtype="<u8", buffer=padded.data, strides=(1,))
    h = ((words[: n - ANCHOR + 1] * _M1) ^ words[8 : n - ANCHOR + 9]) * _M2 + words[ANCHOR - 8 : n - 7] * _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    firsts, lasts, hashes = [], [], []
    block = 1 << 23  # so that a place fits beside the hash
    for lo in range(0, len(h) - w + 1, block):
        part = h[lo : lo + block + w - 1]
        m = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= w:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if w > size:
            m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
        at = (m & _LOW).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        firsts.append(first + lo)
        lasts.append(np.append(first[1:], len(at)) - 1 + lo)
        hashes.append(part[at[first]])
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different key and where it is."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    cut = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else []
    for a, b in zip(cut, np.append(cut[1:], len(k))):
        yield int(k[a]), order[a:b]


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


BLOBS = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("strings", pa.binary())])
BLOBS_SQL = "bucket int, salt int, keys binary, docs binary, strings binary"
MARKS = pa.schema([("id", pa.int64()), ("marks", pa.binary())])
MARKS_SQL = "id long, marks binary"


def _addresses(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket (upper half) and 32-bit key of anchors. Two anchors of one address are taken for one, which only adds candidates."""
    return (((hashes >> np.uint64(24)) % np.uint64(n_buckets)) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFF)) | (
        (hashes >> np.uint64(56)) << np.uint64(24)
    )


def _anchor_blobs(length: int, n_buckets: int):
    """For each batch of documents and bucket of anchors: the anchors (keys) and their documents, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids, texts = x.column("id").to_pylist(), x.column("text").to_pylist()
            found = [np.unique(_addresses(anchors(t, length)[2], n_buckets)) for t in texts]
            sizes = [len(h) for h in found]
            if not sum(sizes):
                continue
            where, docs = np.concatenate(found), np.repeat(np.array(ids, dtype=np.int64), sizes)
            salt, keys = int(docs[0]) % SALTS, where.astype(np.uint32)
            rows = [(b, salt, keys[at].tobytes(), _packed(docs[at].tobytes()), None) for b, at in _groups(where >> np.uint64(32))]
            yield _table(BLOBS, rows)

    return run


def _shared(t: pa.Table) -> pa.Table:
    """The anchors of one bucket that two documents or more hold. Each row is a batch, which holds a pair once."""
    b, once, many = t.column("bucket")[0].as_py(), [], []
    for k in t.column("keys").to_pylist():
        u, n = np.unique(np.frombuffer(k, dtype=np.uint32), return_counts=True)
        once.append(u)
        many.append(u[n > 1])
    u, n = np.unique(np.concatenate(once), return_counts=True)
    both = np.union1d(u[n > 1], np.concatenate(many))
    return pa.Table.from_batches([_table(BLOBS, [(b, s, both.tobytes(), None, None) for s in range(SALTS)])])


def _candidates(n_buckets: int):
    """For the batches of one bucket and salt: the shared anchors, dealt by their documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        keep = np.frombuffer(right.column("keys")[0].as_py(), dtype=np.uint32) if right.num_rows else np.zeros(0, np.uint32)
        if len(keep) and left.num_rows:
            high = np.uint64(left.column("bucket")[0].as_py()) << np.uint64(32)
            where, docs = [], []
            for k, d in zip(left.column("keys").to_pylist(), left.column("docs").to_pylist()):
                h = np.frombuffer(k, dtype=np.uint32)
                ok = keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h
                where.append(h[ok].astype(np.uint64) | high)
                docs.append(np.frombuffer(_unpacked(d), dtype=np.int64)[ok])
            where, docs = np.concatenate(where), np.concatenate(docs)
            rows = [
                (b, 0, where[at].tobytes(), _packed(docs[at].tobytes()), None) for b, at in _groups(_doc_bucket(docs, n_buckets))
            ]
        return pa.Table.from_batches([_table(BLOBS, rows)])

    return run


def _copy_blobs(n_buckets: int):
    """The copies, dealt like other documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = np.array(x.column("id").to_pylist(), dtype=np.int64)
            if len(ids):
                rows = [(b, COPIES, b"", _packed(ids[at].tobytes()), None) for b, at in _groups(_doc_bucket(ids, n_buckets))]
                yield _table(BLOBS, rows)

    return run


def _doc_bucket(docs: np.ndarray, n_buckets: int) -> np.ndarray:
    """As the column expression pmod(xxhash64(id), n_buckets): XXH64 of eight bytes, seed 42, for all documents at once."""
    one, two, three, four, five = (np.uint64(p) for p in _PRIMES)
    turned = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    h = np.full(len(docs), (42 + _PRIMES[4] + 8) % (1 << 64), dtype=np.uint64)
    h ^= turned(docs.astype(np.int64).view(np.uint64) * two, 31) * one
    h = turned(h, 27) * one + four
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return np.mod((h ^ (h >> np.uint64(32))).view(np.int64), n_buckets)


def _strings(length: int, n_buckets: int):
    """Runs of windows under shared anchors of one bucket of documents, dealt by the anchor: equal windows meet.

    Equal strings are stored once. keys: for each string its length, the number of its places, and its anchor; docs: for each place the
    document and the position; strings: all of them, concatenated.
    """

    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        if not texts.num_rows or not marks.num_rows:
            return pa.Table.from_batches([_table(BLOBS, [])])
        copies = set()
        for salt, d in zip(marks.column("salt").to_pylist(), marks.column("docs").to_pylist()):
            if salt == COPIES:
                copies.update(np.frombuffer(_unpacked(d), dtype=np.int64).tolist())
        marks = marks.filter(pa.compute.not_equal(marks.column("salt"), COPIES))
        if not marks.num_rows:
            return pa.Table.from_batches([_table(BLOBS, [])])
        where = np.concatenate([np.frombuffer(k, dtype=np.uint64) for k in marks.column("keys").to_pylist()])
        docs = np.concatenate([np.frombuffer(_unpacked(d), dtype=np.int64) for d in marks.column("docs").to_pylist()])
        order = np.argsort(docs, kind="stable")
        where, docs = where[order], docs[order]
        shards: dict[int, tuple[dict[bytes, int], array]] = {}
        places: dict[int, array] = {}
        for doc, text in zip(texts.column("id").to_pylist(), texts.column("text").to_pylist()):
            a, b = np.searchsorted(docs, [doc, doc + 1])
            if a == b or doc in copies:
                continue
            first, last, hashes = anchors(text, length)
            at = _addresses(hashes, n_buckets)
            ok = np.isin(at, where[a:b])
            at = at[ok]
            for s, key, lo, hi in zip((at >> np.uint64(32)).tolist(), (at & np.uint64(0xFFFFFFFF)).tolist(), first[ok].tolist(), last[ok].tolist()):
                strings, anchor = shards.setdefault(s, ({}, array("q")))
                which = strings.setdefault(text[lo : hi + length], len(strings))
                if which == len(anchor):
                    anchor.append(key)
                places.setdefault(s, array("q")).extend((which, doc, lo))
        rows = []
        for s in list(shards):
            (strings, anchor), spots = shards.pop(s), np.array(places.pop(s), dtype=np.int64).reshape(-1, 3)
            spots = spots[np.argsort(spots[:, 0], kind="stable")]
            sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
            keys = np.stack([sizes, np.bincount(spots[:, 0], minlength=len(strings)), anchor], axis=1)
            rows.append((s, 0, _packed(keys.tobytes()), _packed(spots[:, 1:].tobytes()), _packed(b"".join(strings))))
        return pa.Table.from_batches([_table(BLOBS, rows)])

    return run


def window_owners(strings: list[bytes], owners: np.ndarray, length: int, budget: int) -> np.ndarray:
    """For each byte of the strings, joined by one zero each: the least owner of the window that starts there.

    The suffixes of the joined strings are sorted with their common prefixes; a run of common prefixes of the full length
    is a class of equal windows. Bytes are shifted by one, so that zero is free (UTF-8 has no 255).
    """
    joined = np.frombuffer(b"\xff".join(strings) + b"\xff", dtype=np.uint8) + np.uint8(1)
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)) + 1
    own = np.repeat(owners, sizes)
    out = np.full(len(joined), np.iinfo(np.int64).max, dtype=np.int64)
    run, owner = [], np.iinfo(np.int64).max  # the class that is still open at the end of a block
    for pos, lcp in sorted_suffixes(joined, length, budget):
        start = np.flatnonzero(lcp < length)
        if not len(start) or start[0]:  # the block begins inside the open class
            head = pos[: start[0] if len(start) else len(pos)]
            run.append(head)
            owner = min(owner, int(own[head].min()))
        if not len(start):
            continue
        for part in run:
            out[part] = owner
        least = np.minimum.reduceat(own[pos], start)
        out[pos[start[0] :]] = np.repeat(least, np.diff(np.append(start, len(pos))))
        run, owner = [pos[start[-1] :]], int(least[-1])
    for part in run:
        out[part] = owner
    return out


def _removals(length: int, budget: int):
    """For one shard: the runs of window starts of each document that an earlier one holds too."""

    def run(t: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        which, docs, places, anchor = [], [], [], array("q")
        for k, d, s in zip(*(t.column(c).to_pylist() for c in ("keys", "docs", "strings"))):
            keys = np.frombuffer(_unpacked(k), dtype=np.int64).reshape(-1, 3)
            spots = np.frombuffer(_unpacked(d), dtype=np.int64).reshape(-1, 2)
            text, at, ids = _unpacked(s), 0, []
            for n, key in zip(keys[:, 0].tolist(), keys[:, 2].tolist()):
                ids.append(number.setdefault(text[at : at + n], len(number)))
                if ids[-1] == len(anchor):
                    anchor.append(key)
                at += n
            which.append(np.repeat(np.array(ids, dtype=np.int64), keys[:, 1]))
            docs.append(spots[:, 0])
            places.append(spots[:, 1])
        which, docs, places = np.concatenate(which), np.concatenate(docs), np.concatenate(places)
        strings, anchor = list(number), np.array(anchor, dtype=np.int64)
        owners = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(owners, which, docs)
        latest = np.full(len(strings), np.iinfo(np.int64).min)
        np.maximum.at(latest, which, docs)
        # equal windows have equal anchors, so an anchor of one document has nothing to remove and needs no sorting
        _, of = np.unique(anchor, return_inverse=True)
        low, high = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), np.iinfo(np.int64).min)
        np.minimum.at(low, of, owners)
        np.maximum.at(high, of, latest)
        wanted = (low < high)[of]
        new = np.cumsum(wanted) - 1
        strings = [x for x, w in zip(strings, wanted.tolist()) if w]
        ok = wanted[which]
        which, docs, places, owners = new[which[ok]], docs[ok], places[ok], owners[wanted]
        if not strings:
            return pa.Table.from_batches([_table(MARKS, [])])
        least = window_owners(strings, owners, length, budget)
        sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        heads = np.append(0, np.cumsum(sizes + 1)[:-1])
        windows = sizes - length + 1
        rows = []
        for lo in range(0, len(which), 40_000):
            w, d, p = (v[lo : lo + 40_000] for v in (which, docs, places))
            n = windows[w]
            of = np.repeat(np.arange(len(w)), n)
            step = np.arange(len(of)) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
            gone = least[heads[w][of] + step] < d[of]
            of, start = of[gone], (p[of] + step)[gone]
            if not len(of):
                continue
            cut = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)))
            end = start[np.append(cut[1:], len(of)) - 1] + length
            spans = np.stack([start[cut], end], axis=1)
            rows += [(doc, spans[at].tobytes()) for doc, at in _groups(d[of[cut]])]
        return pa.Table.from_batches([_table(MARKS, rows)])

    return run


def merged_spans(marks: list[bytes]) -> np.ndarray:
    """Maximal runs of the union of [start, end) pairs."""
    spans = np.concatenate([np.frombuffer(m, dtype=np.int64).reshape(-1, 2) for m in marks])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > far[:-1])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], far[np.append(first[1:], len(spans)) - 1]], axis=1)


RESULT = [
    ("id", pa.int64(), "long"), ("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"),
    ("kept_sha256", pa.string(), "string"), ("kept", pa.binary(), "binary"), ("kept_text", pa.string(), "string"),
]


def _results(length: int, with_kept: bool, carried: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for doc, text, copy, marks in zip(*(x.column(c).to_pylist() for c in ("id", "text", "copy", "marks"))):
                if copy and len(text) >= length:
                    spans = np.array([[0, len(text)]])
                else:
                    spans = merged_spans(marks) if marks else np.zeros((0, 2), dtype=np.int64)
                pieces, at = [], 0
                for a, b in spans.tolist():
                    pieces.append(text[at:a])
                    at = b
                pieces.append(text[at:])
                kept = b"".join(pieces)
                sha = hashlib.sha256(kept).hexdigest()
                whole = "".join([p.decode("utf-8", "ignore") for p in pieces]) if with_kept else None
                rows.append((doc, len(text), len(text) - len(kept), len(spans), sha, kept if with_kept else None, whole))
            columns = [pa.array(list(c), kind) for c, (_, kind, _) in zip(zip(*rows) if rows else [[]] * len(RESULT), RESULT)]
            more = [x.column("row")] if carried else []
            yield pa.RecordBatch.from_arrays(columns + more, names=[n for n, *_ in RESULT] + ["row"] * carried)

    return run


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    budget: int = 8 << 20,
    with_kept: bool = False,
    carry: list[str] | None = None,
) -> DataFrame:
    """Remove every byte that is covered by a string of length bytes that also starts in a row with a smaller id.

    1. Rows whose whole text is in a row with a smaller id are set aside: all their bytes go (if there are length of them).
    2. Every window of length bytes has an anchor. Anchors are counted by bucket; those of two rows or more are candidates.
       Only a window under such an anchor can be repeated, so nothing is lost, and single text is not sorted at all.
    3. Runs of windows under a shared anchor go to the shard of the anchor, equal runs of a batch once. There the suffixes
       of the different strings are sorted by external induction, whose common-prefix values give the classes of equal
       windows; a window goes if its class starts in a smaller id. Queues over budget bytes go to disk.
    4. The spans of each row are merged and cut out.
    A shard holds about BUCKET_BYTES of candidate text at any size of the input; a bucket's pairs of anchor and row are
    filtered under SALTS salts; what a task holds for a passage of very many rows is 16 bytes a row.

    Edge cases: a null text is an empty one; texts under length bytes lose nothing; rows with a null id come after all
    others, and rows that repeat an id after one another, in the order of the table: each counts as a document of its own
    (only then are the texts first sorted by id and numbered, which writes them once more); an empty table gives no rows;
    other columns are ignored.
    Returns id_col, n_bytes, n_removed, n_spans, kept_sha256; if asked for also kept (bytes) and kept_text (without
    characters that a cut went through), and the columns of carry in a struct named row.
    """
    spark = df.sparkSession
    src = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )
    light = lambda x: staged(x.select("id", F.octet_length("text").alias("n"), F.unhex(F.md5("text")).alias("g")), "texts")
    sizes = light(src)
    numbered = bool(sizes.filter("id is null").limit(1).count() or sizes.groupBy("id").count().filter("count > 1").limit(1).count())
    if numbered:
        order = [F.col("id").asc_nulls_last(), F.col("_n")]
        rows = src.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        src = staged(rows.drop("_n").withColumnRenamed("id", "_id").withColumn("id", F.monotonically_increasing_id()), "numbered")
        sizes = light(src)
    total = sizes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    n_buckets = max(partitions(spark), -(-total // BUCKET_BYTES))
    firsts = sizes.groupBy("g").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))  # a text may be in a third of all rows
    copies = sizes.select("id", "g", F.pmod(F.xxhash64("id"), F.lit(32)).cast("int").alias("salt")).join(salted, ["g", "salt"])
    copies = _freed(copies.filter("id > first").select("id").distinct(), "copies")

    long_ = src.select("id", "text").filter(F.length("text") >= length)
    pairs = _freed(long_.mapInArrow(_anchor_blobs(length, n_buckets), BLOBS_SQL), "anchors", sizes)
    shared = pairs.select("bucket", "keys").groupBy("bucket").applyInArrow(_shared, BLOBS_SQL)
    marked = pairs.groupBy("bucket", "salt").cogroup(shared.groupBy("bucket", "salt"))
    candidates = _freed(marked.applyInArrow(_candidates(n_buckets), BLOBS_SQL), "candidates", pairs)

    marked = candidates.unionByName(copies.mapInArrow(_copy_blobs(n_buckets), BLOBS_SQL))
    texts = long_.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(n_buckets)).cast("int"))
    strings = texts.groupBy("bucket").cogroup(marked.groupBy("bucket")).applyInArrow(_strings(length, n_buckets), BLOBS_SQL)
    strings = _freed(strings, "strings", candidates)
    spans = _freed(strings.groupBy("bucket").applyInArrow(_removals(length, budget), MARKS_SQL), "spans", strings)
    by_row = spans.groupBy("id").agg(F.collect_list("marks").alias("marks"))
    flags = by_row.join(copies.withColumn("copy", F.lit(True)), "id", "full")
    shown = F.col("_id") if numbered else F.col("id")
    out = src.join(flags, "id", "left").select(
        shown.alias("id"), "text", F.coalesce("copy", F.lit(False)).alias("copy"), "marks", *(["row"] if carry else [])
    )
    schema = ", ".join(f"{n} {kind}" for n, _, kind in RESULT)
    if carry:
        schema += f", row {src.schema['row'].dataType.simpleString()}"
    result = out.mapInArrow(_results(length, with_kept, bool(carry)), schema)
    return (result if with_kept else result.drop("kept", "kept_text")).withColumnRenamed("id", id_col)
