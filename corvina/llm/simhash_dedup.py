"""SimHash near-duplicates by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import partitions, staged
from corvina.llm.components import components
from corvina.llm.simhash import majority, shingle_hashes

BITS = 64
#: A trie node of so many fingerprints or fewer is a leaf bucket; pairs of leaves are compared whole.
LEAF = 8
#: Node pairs that are traversed at once; it bounds the memory of the traversal.
FRONTIER = 1 << 18
#: Salts under which a fingerprint's documents, and a component's fingerprints, are dealt out.
SALTS = 32
#: Fingerprints of a block that a task takes, on average, and at most of one lead before its tries are split.
TASK_ROWS = 250_000


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int, carry: list[str] | None = None) -> DataFrame:
    """(id, fp long) for each row of df, and the columns of carry in a struct named row; the long holds the 64 bits as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fps = [majority(shingle_hashes((t or b"").lower(), shingle)) for t in x.column("text").to_pylist()]
            columns = {"id": x.column("id"), "fp": pa.array(np.array(fps, dtype=np.uint64).view(np.int64))}
            if carry:
                columns["row"] = x.column("row")
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    src = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), *([F.struct(*carry).alias("row")] if carry else [])
    )
    return src.mapInArrow(run, "id long, fp long" + (f", row {src.schema['row'].dataType.simpleString()}" if carry else ""))


def merged(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite a[i] and b[i] in the forest up, in which smaller indices are the roots; all pairs at once."""
    while len(a):
        a, b = up[a], up[b]
        while (up[a] != a).any() or (up[b] != b).any():
            a, b = up[a], up[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))


def roots_of(up: np.ndarray) -> np.ndarray:
    while ((far := up[up]) != up).any():
        up = far
    return up


def trie_links(keys: np.ndarray, pairs: tuple[np.ndarray, ...], top: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Join of binary tries: for each of pairs (alo, ahi, blo, bhi, diff) the tries over keys[alo:ahi] and keys[blo:bhi],
    a trie with itself included; yields index pairs that lie within the budget.

    keys: sorted, different unsigned 64-bit numbers; the keys of a trie agree on their highest top bits, in which the two
    tries of a pair differ by diff bits. A node is a range of keys that share a prefix. The traversal takes pairs of nodes, one bit deeper each step: children on the same side
    keep their differing bits, those on opposite sides gain one, and a pair over the budget is pruned. Pairs of nodes whose
    remaining bits can't exceed the budget are linked as stars without being compared; pairs of leaves are compared whole.
    """
    stack = [(top, *pairs)] if len(pairs[0]) else []
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack.append((depth, *(v[half:] for v in (alo, ahi, blo, bhi, diff))))
            alo, ahi, blo, bhi, diff = (v[:half] for v in (alo, ahi, blo, bhi, diff))
        na, nb, same = ahi - alo, bhi - blo, alo == blo
        sure = (diff + (BITS - depth) <= budget) & ((na > 1) | ~same)
        if sure.any():
            for lo, hi, lo2, hi2 in zip(alo[sure], ahi[sure], blo[sure], bhi[sure]):
                rest = np.concatenate([np.arange(lo, hi), np.arange(lo2, hi2)])
                yield np.full(len(rest), lo), rest
        leaf = ~sure & (np.maximum(na, nb) <= LEAF)
        if leaf.any():
            lo, w, lo2, w2 = alo[leaf], na[leaf], blo[leaf], nb[leaf]
            for i in range(int(w.max())):
                for j in range(int(w2.max())):
                    a, b = lo + i, lo2 + j
                    ok = (i < w) & (j < w2) & (a < b)
                    a, b = a[ok], b[ok]
                    near = np.bitwise_count(keys[a] ^ keys[b]) <= budget
                    if near.any():
                        yield a[near], b[near]
        deep = ~sure & ~leaf
        if not deep.any() or depth >= BITS:
            continue
        alo, ahi, blo, bhi, diff, same = (v[deep] for v in (alo, ahi, blo, bhi, diff, same))
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        amid, bmid = _middle(keys, alo, ahi, bit), _middle(keys, blo, bhi, bit)
        parts = [
            (alo, amid, blo, bmid, diff, True),
            (amid, ahi, bmid, bhi, diff, True),
            (alo, amid, bmid, bhi, diff + 1, True),
            (amid, ahi, blo, bmid, diff + 1, False),
        ]
        kept = []
        for lo, hi, lo2, hi2, d, mirror in parts:
            ok = (hi > lo) & (hi2 > lo2) & (d <= budget)
            if not mirror:
                ok &= ~same  # a node with itself has its two mixed pairs once
            kept.append(tuple(v[ok] for v in (lo, hi, lo2, hi2, d)))
        stack.append((depth + 1, *(np.concatenate(v) for v in zip(*kept))))


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First index of keys[lo:hi] with the bit set, by bisection of all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = open_ & ((keys[np.minimum(mid, len(keys) - 1)] & bit) != 0)
        hi = np.where(one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _rotations(budget: int) -> list[tuple[int, int]]:
    """budget + 1 blocks of the 64 bits: (how far to rotate left so that the block leads, its width)."""
    edges = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return x if by == 0 else (x << np.uint64(by)) | (x >> np.uint64(BITS - by))


def links(fps: DataFrame, budget: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all pairs within the budget; stars, not all pairs.

    Two fingerprints within the budget agree on one of budget + 1 blocks. Each fingerprint goes to each of its blocks,
    rotated so that the block leads; the tries of a block's fingerprints are joined from below the block. A lead of more
    than task_rows fingerprints is split by its next bits into nodes, and every pair of nodes that differ in no more bits
    than the budget is a group of its own. Of the pairs found in a task only a spanning forest leaves it, so a group of near
    copies gives as many links as members.
    """
    plan = _rotations(budget)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        x = pd.concat(got) if got else pd.DataFrame({"block": [], "deep": [], "u": [], "v": [], "fp": []})
        for (k, deep), part in x.groupby(["block", "deep"]):
            by, width = plan[int(k)]
            top = width + int(deep)
            keys = _rotl(part["fp"].to_numpy(np.int64).view(np.uint64), by)
            order, pairs = tries(keys, part["u"].to_numpy(np.int64), part["v"].to_numpy(np.int64), top, int(deep))
            keys = keys[order]
            up = np.arange(len(keys))
            for a, b in trie_links(keys, pairs, top, budget):
                merged(up, a, b)
            root = roots_of(up)
            linked = np.flatnonzero(root != np.arange(len(keys)))
            back = _rotl(keys, (BITS - by) % BITS).view(np.int64)
            yield pd.DataFrame({"a": back[linked], "b": back[root[linked]]})

    n = fps.count()
    blocks = F.array(*(
        F.struct(F.lit(k).alias("block"), _block_value("fp", by, width).alias("lead"), _block_value("fp", (by + width) % BITS, DEEP).alias("next"))
        for k, (by, width) in enumerate(plan)
    ))
    each = fps.select("fp", F.explode(blocks).alias("x")).select("fp", "x.*")
    nodes = split_leads(each, n, budget, task_rows)
    tasks = max(partitions(fps.sparkSession), -(-n * len(plan) // task_rows))
    dealt = nodes.repartition(tasks, "block", "lead", "u", "v").select("block", "deep", "u", "v", "fp")
    return dealt.mapInPandas(join, "a long, b long")


def tries(keys: np.ndarray, u: np.ndarray, v: np.ndarray, top: int, deep: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(order, pairs): how a task's keys of one table are sorted, and the pairs of tries that trie_links() joins over them.

    u, v: the nodes below the lead (top - deep bits) that a row's group is made of; equal where a node meets itself.
    """
    order = np.lexsort((keys, v, u))
    keys, u, v = keys[order], u[order], v[order]
    lead = keys >> np.uint64(BITS - top)
    group = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (lead[1:] >> np.uint64(deep) != lead[:-1] >> np.uint64(deep)))
    cut = np.flatnonzero(group | np.append(True, lead[1:] != lead[:-1]))
    ends = np.append(cut[1:], len(keys))
    own = (u == v)[cut] & (ends - cut > 1)  # a node with itself; else the two nodes of a group
    first = np.flatnonzero(~(u == v)[cut] & group[cut])
    first = first[first + 1 < len(cut)]
    first = first[~group[cut[first + 1]]]
    diff = np.bitwise_count(lead[cut[first]] ^ lead[cut[np.minimum(first + 1, len(cut) - 1)]]).astype(np.int64)
    return order, (
        np.concatenate([cut[own], cut[first]]), np.concatenate([ends[own], ends[first]]),
        np.concatenate([cut[own], cut[first + 1]]), np.concatenate([ends[own], ends[first + 1]]),
        np.concatenate([np.zeros(own.sum(), dtype=np.int64), diff]),
    )


def split_leads(each: DataFrame, n: int, budget: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """each (block, lead, next, ...) of n fingerprints with deep, u, v in place of next: leads of more than task_rows rows are
    split by deep further bits (of next, their first DEEP), and a row goes to each pair of nodes within the budget that its own is in."""
    rest = [c for c in each.columns if c not in ("block", "lead", "next")]
    if n <= task_rows:  # no lead can be over it
        return each.select("block", "lead", *rest, *(F.lit(0).alias(c) for c in ("deep", "u", "v")))
    sizes = each.groupBy("block", "lead").agg(F.count("*").alias("n")).filter(F.col("n") > task_rows)
    bits = F.least(F.lit(DEEP), F.ceil(F.log2(F.col("n") / task_rows))).cast("int")
    split = each.join(F.broadcast(sizes.select("block", "lead", bits.alias("deep"))), ["block", "lead"], "left")  # at most rows / task_rows leads
    split = split.withColumn("deep", F.coalesce("deep", F.lit(0))).withColumn("c", F.call_function("shiftright", F.col("next"), F.lit(DEEP) - F.col("deep")).cast("int"))
    near = F.filter(
        F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("deep")) - 1), lambda y: F.bit_count(y.bitwiseXOR(F.col("c"))) <= budget
    )
    return split.withColumn("y", F.explode(near)).select("block", "lead", *rest, "deep", F.least("c", "y").alias("u"), F.greatest("c", "y").alias("v"))


#: A lead's tries are split by at most so many further bits.
DEEP = 10


def _block_value(name: str, start: int, width: int) -> Column:
    """width bits of the fingerprint from bit start (the highest is 0), going on at the front beyond the end."""
    over = start + width - BITS
    if over > 0:
        low = _block_value(name, 0, over)
        return F.shiftleft(_block_value(name, start, width - over), over).bitwiseOR(low)
    shifted = F.shiftrightunsigned(name, BITS - start - width)
    return shifted.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4, carry: list[str] | None = None
) -> DataFrame:
    """One row for each row of df: id_col, fingerprint (16 hex digits), component_id (smallest id that links reach), first:
    whether this is the row that stands for its component; carry: columns of df that come along in a struct named row.

    Fingerprints are the majority bits of XXH64 of all shingles of the lower-cased (A-Z) words; they link at budget or
    fewer differing bits. Equal fingerprints are one node throughout, so copies are neither joined nor paired.
    Edge cases: null and blank texts have fingerprint zero, linked like any other; texts shorter than a shingle count
    whole; repeated rows and ids share their component, of which one row is first; a null id is never the smallest and gets
    its component's id (null if it has no other); an empty table gives no rows; other columns are ignored.
    """
    source = fingerprints(df, id_col, text_col, shingle, carry).withColumn("n", F.monotonically_increasing_id())
    marked = staged(salted(source), "fingerprints")
    nodes = staged(nodes_of(marked, "fp"), "nodes")
    found = grouped(marked, nodes, components(staged(links(nodes.select("fp"), budget), "links")), "fp")
    return found.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "first", *(["row"] if carry else [])
    )


def salted(source: DataFrame) -> DataFrame:
    """source with the salt of each of its rows n, under which a hot node's rows are dealt out."""
    return source.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int"))


def nodes_of(marked: DataFrame, key: str, *more: Column) -> DataFrame:
    """One row for each different key of marked (id, n, salt): its least row, the salts that its rows have, and more aggregates."""
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n"))
    return marked.groupBy(key).agg(least.alias("least"), F.collect_set("salt").alias("salts"), *more)


def grouped(marked: DataFrame, nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """marked with component_id (the smallest id of those that have its key's root) and first (whether the row stands for all).

    roots: (node, root) for keys with a link, as components() gives them; a key that isn't there is its own.
    """
    mine = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    reached = roots.withColumnRenamed("node", "reached")
    labelled = nodes.join(reached, F.col(key) == F.col("reached"), "left").select(
        key, "salts", "least", F.coalesce("root", key).alias("root"), mine.alias("salt")
    )
    smallest = labelled.groupBy("root").agg(F.min("least").alias("m"), F.collect_set("salt").alias("of"))
    smallest = smallest.select("root", "m", F.explode("of").alias("salt"))
    found = labelled.join(smallest, ["root", "salt"]).select(key, "m", F.explode("salts").alias("salt"))
    return marked.join(found, [key, "salt"]).withColumns({"component_id": F.col("m.id"), "first": F.col("n") == F.col("m.n")})
