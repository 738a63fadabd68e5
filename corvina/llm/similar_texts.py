"""Near-duplicates by exact similarity: SimHash tries of many tables propose pairs, shared shingles decide, and pairs that no
table proposed are found by the prefixes of their sets, first roughly, then in the exact order of frequency."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import forget, partitions, staged, unstaged
from corvina.llm.components import components
from corvina.llm.simhash import hamming, shingle_hashes
from corvina.llm.simhash_dedup import BITS, DEEP, TASK_ROWS, grouped, nodes_of, salted, split_leads, tries, trie_links
from corvina.shared import small

#: Bits of a fingerprint, from which each table takes its own 64.
POOL = 256
#: Share of pairs at exactly the wanted similarity that may be missed by the leads of all tables together.
MISSED = 0.04
#: Rounds in which only the nearest proposal of each node, or component, is verified.
ROUNDS = 1
#: Texts, about, from which the order of shingles in prefixes is learned, and the frequent shingles it holds. Any order gives the same links.
ORDER_TEXTS, ORDER_SHINGLES = 4000, 50_000
#: Share of the least partner of a set by which its prefix is longer than the shortest that does; so many shingles more are shared there.
BEYOND = 1 / 16
#: Nodes of one shingle that meet as one unit; more are dealt into cells of so many.
PREFIX_CELL = 2048
#: Rows of a few numbers that are written into one file, about, where a table has at most as many as there are nodes.
FILE_ROWS = 100_000
#: Odd constants that make four 64-bit words out of one hash.
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def bit_share(similarity: float) -> float:
    """Share of SimHash bits in which two sets of equal size and this Jaccard similarity differ, in expectation."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(n: int, similarity: float) -> tuple[int, int, int]:
    """(lead bits, tables, budget in the bits after the lead) for n fingerprints.

    The lead grows with the logarithm of n, so that few fingerprints share one by chance, and the tables with it, so that a
    pair at the similarity agrees on the lead of one of them as often at any size. The budget is two and a half deviations over the mean.
    """
    lead = min(40, max(16, math.ceil(math.log2(max(n, 2))) - 2))
    p = bit_share(similarity)
    tables = math.ceil(math.log(MISSED) / math.log(1 - (1 - p) ** lead))
    rest = BITS - lead
    return lead, tables, min(rest, math.ceil(rest * p + 2.5 * math.sqrt(rest * p * (1 - p))))


def table_bits(table: int) -> np.ndarray:
    """The 64 of the pool's bits that a table takes, in its order; a rule, not data."""
    return np.random.default_rng(1000 + table).permutation(POOL)[:BITS]


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted different hashes of the shingles of the lower-cased (A-Z) words."""
    return np.unique(shingle_hashes(text.lower(), shingle))


def set_fingerprint(found: np.ndarray) -> bytes:
    """256 majority bits over the members of a set, each member giving four mixed words."""
    if not len(found):
        return bytes(POOL // 8)
    words = np.empty((len(found), len(MIXERS)), dtype=np.uint64)
    for k, m in enumerate(MIXERS):
        x = (found ^ np.uint64(k)) * np.uint64(m)
        x ^= x >> np.uint64(29)
        x *= np.uint64(MIXERS[(k + 1) % len(MIXERS)])
        words[:, k] = x ^ (x >> np.uint64(32))
    votes = np.zeros(POOL, dtype=np.int64)
    for lo in range(0, len(found), 4096):  # bounds what a long text's bits take
        part = np.unpackbits(words[lo : lo + 4096].astype(">u8").view(np.uint8).reshape(-1, POOL // 8), axis=1)
        votes += part.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(found)).tobytes()


def frequent_shingles(df: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """Shingles of more than one text of a bounded sample (by hash), the rarest first: those that prefixes take last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [shingle_set(t.encode(), shingle) for t in x.column("text").to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    every = max(1, df.count() // ORDER_TEXTS)
    text = df.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    some = text.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    seen = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    top = seen.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).select("h").collect()
    return np.array([r["h"] for r in reversed(top)], dtype=np.int64).view(np.uint64)


def least_shared(size: int, similarity: float) -> int:
    """Shingles that a set of this size shares with each similar set of its size or more within their prefixes."""
    return 1 + math.floor(BEYOND * similarity * size)


def prefix(found: np.ndarray, similarity: float, late: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first members of a set in the order of all shingles: those that aren't in late by hash, then those of late by rank.

    late: sorted hashes. Two sets of this similarity share least_shared() of the smaller one within these, whatever the order is.
    """
    n = len(found) - math.ceil(similarity * len(found) - 1e-9) + least_shared(len(found), similarity)
    if not len(found):
        return found
    place = np.zeros(len(found), dtype=np.int64)
    if len(late):
        at = np.minimum(np.searchsorted(late, found), len(late) - 1)
        place = np.where(late[at] == found, rank[at] + 1, 0)
    return found[np.argsort(place, kind="stable")[:n]]


def _marked(df: DataFrame, id_col: str, text_col: str, shingle: int, carry: list[str], similarity: float) -> DataFrame:
    frequent = frequent_shingles(df, text_col, shingle)
    rank = np.argsort(frequent)
    late = frequent[rank]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for x in batches:
            texts = x.column("row").field(at).to_pylist()
            sets = [shingle_set((t or "").encode(), shingle) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], dtype=np.uint64).view(np.int64)
            fp = pa.array([set_fingerprint(s) for s in sets], pa.binary())
            size = pa.array([len(s) for s in sets], pa.int32())
            first = pa.array([prefix(s, similarity, late, rank).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([x.column("id"), pa.array(node), fp, size, first, x.column("row")], names=["id", "node", "fp", "size", "prefix", "row"])

    at = carry.index(text_col)
    src = df.select(F.col(id_col).cast("long").alias("id"), F.struct(*carry).alias("row"))
    return src.mapInArrow(run, f"id long, node long, fp binary, size int, prefix array<long>, row {src.schema['row'].dataType.simpleString()}")


def proposals(nodes: DataFrame, similarity: float, task_rows: int = TASK_ROWS) -> DataFrame:
    """Different pairs (a, b), a < b, of nodes (node, fp) that some table's trie join finds within its budget.

    Each table orders 64 of the bits anew, the first of them as its lead; below each lead the binary trie is joined with
    itself. A node gives the nearest of those before it in each table and task, so a group of near copies gives a few pairs
    for each member, and not all of them. Returns them with d, the differing bits of the whole fingerprints, of which pairs
    have most_bits() at most.
    """
    n = nodes.count()
    lead, count, budget = tables_for(n, similarity)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.concatenate([table_bits(t) for t in range(count)])
        for x in batches:
            fp = np.frombuffer(b"".join(x.column("fp").to_pylist()), dtype=np.uint8).reshape(-1, POOL // 8)
            for lo in range(0, len(fp), 256):
                bits = np.unpackbits(fp[lo : lo + 256], axis=1)
                keys = np.packbits(bits[:, order], axis=1).reshape(-1, 8).view(">u8").astype(np.uint64).view(np.int64).ravel()
                part = len(bits)
                node = np.repeat(x.column("node").slice(lo, part).to_numpy(), count)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(count, dtype=np.int32), part)), pa.array(keys), pa.array(node)], names=["block", "key", "node"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        got = list(batches)
        x = pd.concat(got) if got else pd.DataFrame({"block": [], "deep": [], "u": [], "v": [], "key": [], "node": []})
        for (_, deep), part in x.groupby(["block", "deep"]):
            keys = part["key"].to_numpy(np.int64).view(np.uint64)
            order, pairs = tries(keys, part["u"].to_numpy(np.int64), part["v"].to_numpy(np.int64), lead + int(deep), int(deep))
            keys, node = keys[order], part["node"].to_numpy(np.int64)[order]
            none = np.iinfo(np.int64).max
            before = np.full(len(keys), none)
            for a, b in trie_links(keys, pairs, lead + int(deep), budget):
                a, b = a[a != b], b[a != b]
                a, b = np.minimum(a, b), np.maximum(a, b)
                d = np.bitwise_count(keys[a] ^ keys[b]).astype(np.int64) << 32
                np.minimum.at(before, b, d | a)
            at = np.flatnonzero(before != none)
            a, b = node[at], node[before[at] & 0xFFFFFFFF]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    each = nodes.select("node", "fp").mapInArrow(keyed, "block int, key long, node long")
    each = each.withColumn("lead", F.shiftrightunsigned("key", BITS - lead))
    each = each.withColumn("next", F.shiftrightunsigned(F.shiftleft("key", lead), BITS - DEEP))
    tasks = max(partitions(nodes.sparkSession), -(-n * count // (8 * task_rows)))
    dealt = split_leads(each, n, budget, task_rows).repartition(tasks, "block", "lead", "u", "v")
    pairs = staged(dealt.select("block", "deep", "u", "v", "key", "node").mapInPandas(join, "a long, b long").filter("a <> b").distinct(), "proposed")

    @F.pandas_udf("int")
    def differing(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(v), dtype=np.uint8).reshape(-1, POOL // 8) for v in (a, b))
        return pd.Series(hamming(x, y).astype(np.int32))

    near = pairs.join(nodes.select(F.col("node").alias("a"), F.col("fp").alias("fa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("fp").alias("fb")), "b")
    return near.select("a", "b", differing("fa", "fb").alias("d")).filter(F.col("d") <= most_bits(similarity))


def most_bits(similarity: float) -> int:
    """Differing bits of whole fingerprints, three and a half deviations over what the similarity leads to."""
    p = bit_share(similarity)
    return math.ceil(POOL * p + 3.5 * math.sqrt(POOL * p * (1 - p)))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, found: sorted hashes as bytes) have this Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for p, q in zip(x.column("sa"), x.column("sb")):
                p, q = np.frombuffer(p.as_py(), dtype=np.uint64), np.frombuffer(q.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("node").alias("a"), F.col("found").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("found").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def few(df: DataFrame, n: int) -> DataFrame:
    """df, of about n short rows or fewer, in partitions of FILE_ROWS; its many small files would each cost a file system's call."""
    return df.coalesce(files_for(df, n))


def files_for(df: DataFrame, n: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-n // FILE_ROWS))


def joined(roots: DataFrame | None, links: DataFrame, n: int) -> DataFrame:
    """(node, root) of the components that roots and further links (a, b) make together, among n nodes."""
    if roots is not None:
        links = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)
    return staged(few(components(links, files_for(links, n)), n), "roots")


def linked(near: DataFrame, sets: DataFrame, similarity: float, n: int) -> DataFrame:
    """(node, root) of the components of all proposed pairs near (a, b, d) that have the similarity; nodes without a link have
    none. n: the number of nodes.

    First each node's nearest proposal is verified (in further ROUNDS each component's); a proposal inside a component needs no
    look any more. What is left between components after that is verified whole, so nothing is left out.
    """
    left, roots = near.select("a", "b", "d", F.col("a").alias("ca"), F.col("b").alias("cb")), None
    for k in range(ROUNDS + 1):
        if k and left.isEmpty():
            break
        some = left.select("a", "b")
        if k < ROUNDS:
            ends = left.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("d", "a", "b").alias("e"))
            some = staged(few(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.a", "e.b").distinct(), n), "chosen")
        roots = joined(roots, staged(verified(some, sets, similarity), "verified"), n)
        if k < ROUNDS:
            rest = left.select("a", "b", "d").join(some, ["a", "b"], "left_anti")
            for end in ("a", "b"):
                of = roots.select(F.col("node").alias(end), F.col("root").alias("r"))
                rest = rest.join(of, end, "left").withColumn(f"c{end}", F.coalesce("r", end)).drop("r")
            left = staged(rest.filter("ca <> cb"), "near")
    return roots


def candidates(nodes: DataFrame, roots: DataFrame, similarity: float, n: int) -> DataFrame:
    """Nodes (node, size, c) of the n nodes (node, size, prefix) that may be similar to one outside their component c.

    A shingle counts if the prefixes of two components have it, which an aggregate tells; a node without least_shared() of
    them (for its smallest partner) has no similar set out there. No pair is formed.
    """
    of = nodes.join(small(roots.withColumnRenamed("node", "reached")), F.col("node") == F.col("reached"), "left")
    of = of.select("node", "size", F.coalesce("root", "node").alias("c"), "prefix")
    mixed = of.select("c", F.explode("prefix").alias("h")).groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    mixed = staged(mixed.filter("least <> most").select("h"), "mixed")
    shared = of.select("node", F.explode("prefix").alias("h")).join(small(mixed), "h").groupBy("node").agg(F.count("*").alias("shared"))
    partner = F.ceil(similarity * F.col("size") - 1e-9)
    enough = shared.join(of.drop("prefix"), "node").filter(F.col("shared") >= 1 + F.floor(BEYOND * similarity * partner - 1e-9))
    out = staged(few(enough.select("node", "size", "c"), n), "candidates")
    unstaged(mixed)
    return out


def rest(some: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of candidates (node, size, c) of different c that may have the similarity: their sizes allow it, and
    so does the place of a shingle that they share. No pair that has it is left out. sets: (node, found: hashes as bytes).

    Of the whole sets the shingles of one component alone are dropped by an aggregate; a node that keeps too few of them for
    any partner goes. Each node's kept shingles are ordered by how many candidates have them, the rarest first, and a
    similar pair shares one of the first. What it shares from its first common shingle on is at most what either has from
    there on (left); a pair for which that is too little doesn't meet there, so sets that are half alike aren't paired for
    each shingle that they share. Shingles with more than PREFIX_CELL nodes are dealt into cells, each pair of cells on its own.
    """

    @F.pandas_udf("array<long>")
    def members(found: pd.Series) -> pd.Series:
        return found.map(lambda x: np.frombuffer(x, dtype=np.int64))

    full = sets.join(some.select("node", "c"), "node").select("node", "c", F.explode(members("found")).alias("h"))
    mixed = full.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("n")).filter("least <> most")
    mixed = staged(mixed.select("h", "n"), "mixed")
    kept = full.select("node", "h").join(small(mixed), "h").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("kept"))
    wanted = F.ceil(similarity * F.col("size") - 1e-9).cast("int")
    kept = kept.join(some, "node").withColumn("over", F.size("kept") - wanted).filter("over >= 0")
    each = kept.select("node", "size", "c", F.size("kept").alias("all"), F.posexplode(F.slice("kept", F.lit(1), F.col("over") + 1)).alias("place", "x"))
    met = each.select("node", "size", "c", F.col("x.h").alias("h"), (F.col("all") - F.col("place")).alias("left"), F.ceil(F.col("x.n") / PREFIX_CELL).cast("int").alias("cells"))
    met = staged(met, "met").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    a = met.select("h", F.col("own").alias("u"), other.alias("v"), F.col("node").alias("a"), F.col("size").alias("na"), F.col("left").alias("la"), F.col("c").alias("ca"))
    b = met.select("h", other.alias("u"), F.col("own").alias("v"), F.col("node").alias("b"), F.col("size").alias("nb"), F.col("left").alias("lb"), F.col("c").alias("cb"))
    apart = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
    fits = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6
    enough = F.least("la", "lb") >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6
    pairs = staged(a.join(b, ["h", "u", "v"]).filter(apart & fits & enough).select("a", "b").distinct(), "rest")
    unstaged(mixed)
    return pairs


def similar(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, carry: list[str] | None = None
) -> DataFrame:
    """One row for each row of df: id_col, fingerprint (64 hex digits), component_id (smallest id that links reach), first
    (whether this is the row that stands for its component), and the columns of carry in a struct named row.

    Two texts link if the Jaccard similarity of their sets of shingles (lower-cased A-Z) is similarity or more; that is
    computed exactly, so nothing is linked wrongly. Pairs are proposed by proposals() and verified by linked(); rest() gives
    all pairs between the components so far that may still have the similarity, and they are verified too, so no link is
    missing. Texts with equal sets are one node throughout. Whole sets are built for nodes of proposed pairs and for
    candidates() alone.

    Edge cases: null and blank texts have the empty set and are one group; a text shorter than a shingle is one shingle;
    repeated rows and ids share their component, of which one row is first; a null id is never the smallest and gets its
    component's id (null if it has no other); an empty table gives no rows; other columns are ignored.
    """
    carry = carry or []
    held = carry if text_col in carry else [*carry, text_col]
    marked = staged(salted(_marked(df, id_col, text_col, shingle, held, similarity).withColumn("n", F.monotonically_increasing_id())), "sets")
    nodes = staged(nodes_of(marked, "node", F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("prefix").alias("prefix")), "nodes")
    near, n = staged(proposals(nodes, similarity), "near"), nodes.count()

    @F.pandas_udf("binary")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_set((t or "").encode(), shingle).tobytes())

    def sets(asked: DataFrame) -> DataFrame:
        asked = asked.join(nodes.select("node", F.col("least.n").alias("n")), "node").select("node", "n")
        texts = marked.select("n", F.col(f"row.{text_col}").alias("text")).join(small(asked), "n")
        return staged(texts.select("node", found("text").alias("found")), "found")

    of = sets(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    roots = linked(near, of, similarity, n)
    unstaged(of)
    some = candidates(nodes, roots, similarity, n)
    if not some.isEmpty():
        of = sets(some)
        more = rest(some, of, similarity)
        if not more.isEmpty():
            roots = joined(roots, staged(verified(more, of, similarity), "links"), n)
        unstaged(of)
    out = grouped(marked.drop("size", "prefix"), nodes, roots, "node")
    row = [F.struct(*(F.col(f"row.{c}").alias(c) for c in carry)).alias("row")] if carry else []
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id", "first", *row)
