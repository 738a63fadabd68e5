"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import staged, unstaged


#: A node's smallest neighbour is looked up under so many salts, so that the edges of one node are dealt out.
SALTS = 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node links its larger (large) or its smaller neighbours and itself to its smallest neighbour."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.collect_set(salt).alias("salts")).withColumn("m", F.least("a", "m"))
    linked = both.withColumn("salt", salt).join(least.select("a", "m", F.explode("salts").alias("salt")), ["a", "salt"])
    if large:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """edges(a, b) -> (node, root): each node that has an edge, with the smallest node it reaches (root itself included).

    files: into so many files, at most, a round's edges are written; without it into one for each partition.

    After every round the edges are written to the shared folder, which also cuts the lineage. Rounds go on until the
    edges stay the same: then every edge leads to its root. The rounds needed grow with the logarithm of the size.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    mark = None
    while True:
        step = _star(_star(now, True), False)
        before, now = now, staged(step.coalesce(files) if files else step, "edges")
        if mark:
            unstaged(before)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.union(out.select(F.col("root").alias("node"), "root").distinct())
