"""Sharding of indivisible groups by Karmarkar-Karp differencing, in levels."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import staged

#: Copies of a group's shard that its rows are dealt over, and pieces of a shard that are numbered on their own.
SALTS = 32
#: Partial partitions that one task of a further level combines at most, on average.
FAN = 1024
#: Rows that are numbered in one sorted run, on average.
RUN_ROWS = 100_000


def differencing(parts: list[tuple[float, ...]]) -> tuple[np.ndarray, tuple[float, ...]]:
    """Combine partial partitions of k sums each into one: (place[i, j] of item i's j-th sum, the k sums).

    The two with the largest spread (largest minus smallest sum) are merged again and again, largest sums on smallest ones.
    """
    n, k = len(parts), len(parts[0])
    sums: list[list[float]] = []
    kids: list[tuple[int, int, list[int]] | None] = []
    orders: list[list[int]] = []  # orders[x][r]: which of x's original or child slots has rank r (largest first)
    for p in parts:
        order = sorted(range(k), key=lambda j: (-p[j], j))
        sums.append([p[j] for j in order])
        orders.append(order)
        kids.append(None)
    heap = [(sums[i][-1] - sums[i][0], i) for i in range(n)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = sums[a], sums[b]
        joined = [x[r] + y[k - 1 - r] for r in range(k)]
        order = sorted(range(k), key=lambda r: (-joined[r], r))
        sums.append([joined[r] for r in order])
        orders.append(order)
        kids.append((a, b, order))
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    top = heap[0][1]
    place = np.zeros((n, k), dtype=np.int64)
    stack = [(top, list(range(k)))]  # node, final bin of each of its ranks
    while stack:
        node, bins = stack.pop()
        if kids[node] is None:
            for r in range(k):
                place[node, orders[node][r]] = bins[r]
            continue
        a, b, order = kids[node]
        of = [0] * k  # final bin of each joined slot before sorting
        for r in range(k):
            of[order[r]] = bins[r]
        stack.append((a, of))
        stack.append((b, [of[k - 1 - r] for r in range(k)]))
    return place, tuple(sums[top])


def _combine(n_shards: int):
    """For the partial partitions under one parent: where each of their parts goes."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(x["bucket"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(nodes), n_shards), dtype=np.int64)
        sums[at, x["part"].to_numpy()] = x["size"].to_numpy()
        place, _ = differencing([tuple(r) for r in sums.tolist()])
        return pd.DataFrame({
            "bucket": np.repeat(nodes, n_shards), "part": np.tile(np.arange(n_shards), len(nodes)),
            "parent": x["parent"].iloc[0], "goes": place.ravel(), "size": sums.ravel(),
        })

    return run


def _combined(placed: DataFrame, n_buckets: int, n_shards: int) -> DataFrame:
    """(bucket, part, shard): the partial partitions of all buckets combined into one, FAN to a task, level by level."""
    nodes = placed.groupBy("bucket", "part").agg(F.sum("size").alias("size"))
    found, n = nodes.select("bucket", "part", F.col("bucket").alias("top"), F.col("part").alias("shard")), n_buckets
    while n > 1:
        n = -(-n // FAN)
        dealt = nodes.withColumn("parent", F.pmod("bucket", F.lit(n)).cast("int"))
        made = dealt.groupBy("parent").applyInPandas(_combine(n_shards), "bucket int, part int, parent int, goes int, size long")
        made = staged(made, "combined")
        step = made.select(F.col("bucket").alias("top"), F.col("part").alias("shard"), "parent", "goes")
        found = found.join(step, ["top", "shard"]).select("bucket", "part", F.col("parent").alias("top"), F.col("goes").alias("shard"))
        nodes = made.groupBy(F.col("parent").alias("bucket"), F.col("goes").alias("part")).agg(F.sum("size").alias("size"))
    return found.select("bucket", "part", "shard")


def shard(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16, max_rows: int = 65_536
) -> DataFrame:
    """Law `bytes`: rows with equal texts stay together, shards get near equal bytes.

    1. Sizes are summed by group (128-bit hash of the text) with map-side aggregation, so a group of any number of rows
       costs one row. 2. Up to max_rows groups are differenced in one task; more are dealt by hash to buckets of about
       max_rows, each differenced into a partial partition of n_shards sums. 3. Partial partitions are items of the same
       method, so they are differenced again, FAN of them to a task, level by level, until one is left.
    The number of buckets depends on the groups alone. Slots are numbered in runs of a shard and shifted by the rows of the
    runs before.

    Edge cases: a null text counts as an empty one (size 1, crc32 0) and is grouped with those; repeated rows and rows with
    a null id are members of their group and each get a slot; fewer groups than shards leave shards empty; an empty table
    gives no rows; other columns are ignored.
    Returns id_col, size, text_crc32, law, shard, slot, grown_shard (null).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("g"),
    )
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    groups = rows.groupBy("g").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.collect_set(salt).alias("salts"))
    groups = staged(groups, "groups")
    n_groups, n_rows = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_buckets = max(1, -(-n_groups // max_rows))
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(n_buckets)).cast("int"))

    def partial(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["size", "g"], ascending=[False, True], kind="stable")
        zeros = (0,) * (n_shards - 1)
        place, _ = differencing([(s, *zeros) for s in x["size"].tolist()])
        return pd.DataFrame({"g": x["g"], "size": x["size"], "bucket": x["bucket"], "part": place[:, 0]})

    dealt = groups.select("g", "size", "bucket").groupBy("bucket")
    placed = staged(dealt.applyInPandas(partial, "g binary, size long, bucket int, part int"), "partial")
    where = placed.join(staged(_combined(placed, n_buckets, n_shards), "shards"), ["bucket", "part"]).select("g", "shard")
    where = where.join(groups.select("g", F.explode("salts").alias("salt")), "g")
    out = rows.withColumn("salt", salt).join(where, ["g", "salt"]).select("id", "size", "text_crc32", "row", "shard")
    n_runs = max(1, -(-n_rows // (n_shards * RUN_ROWS)))
    out = staged(out.withColumn("run", F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(n_runs)).cast("int")), "placed")
    counts = out.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place_in = F.row_number().over(Window.partitionBy("shard", "run").orderBy("id", "row"))
    return out.withColumn("place", place_in).join(offsets, ["shard", "run"]).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
