"""A crawl over a link table that keeps its frontier on disk: one visited set, discovery order, a limit, and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.shared import numbered, small, staged
from corvina.sources.store import got, listed, put_once

ROWS = "id string, level int, rank long, found boolean"


def visited(spark: SparkSession, path: str) -> DataFrame:
    """(id, level, rank, found) of what the crawl under path has visited and noted so far, in the order of rank."""
    last = _last(spark, path)
    levels = [f"{path}/levels/level={k}" for k in range(last["level"] + 1)] if last else []
    return spark.read.schema(ROWS).parquet(*levels) if levels else spark.createDataFrame([], ROWS)


def _last(spark: SparkSession, path: str) -> dict | None:
    names = [n for n in listed(spark, f"{path}/log") if n.endswith(".json")]
    return got(spark, f"{path}/log/{names[-1]}") if names else None


def crawl(
    links: DataFrame, seeds: DataFrame, path: str, nodes: DataFrame | None = None, max_documents: int | None = None, every: int = 1, max_levels: int | None = None
) -> DataFrame:
    """What a queue that begins with seeds visits: (id, level, rank, found), kept under path level by level.

    links: (src, dst[, pos]) with the place of a link in its document (else links go by dst); seeds: (id[, pos]); nodes: (id)
    of documents that exist, all if not given. A node is visited once, when it is first met: after everything of a lower
    level, and inside a level in the order of the document that links to it, then of the link, as a queue does. Nodes that
    don't exist are visited (found is false) and lead nowhere. The crawl ends when nothing new is met or max_documents
    documents were found (what the queue holds beyond is not visited).

    A level is one join of the frontier with the links and one anti-join with the visited nodes, whatever the number of seeds.
    Its rows are written under path, and every few levels a log entry says how far the crawl has come. Called again, it goes on
    after the last entry; levels behind it that a killed run has left are written anew. max_levels ends this call early.
    """
    spark = links.sparkSession
    if "pos" not in links.columns:
        links = links.withColumn("pos", F.col("dst").cast("string"))
    links = links.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "pos").filter("dst is not null")
    known = None if nodes is None else staged(nodes.select(F.col("id").cast("string").alias("id")).distinct().withColumn("found", F.lit(True)), "nodes")
    last = _last(spark, path)
    if last is None:
        order = "pos" if "pos" in seeds.columns else "id"
        first = seeds.select(F.col("id").cast("string").alias("id"), F.col(order).alias("o")).filter("id is not null").groupBy("id").agg(F.struct(F.min("o").alias("o")).alias("at"))
        level, base, documents = 0, 0, 0
        new = first
    else:
        level, base, documents = last["level"] + 1, last["visited"], last["documents"]
        if last["done"]:
            return visited(spark, path)
        new = None
    begun = level
    read = lambda k: spark.read.schema(ROWS).parquet(*[f"{path}/levels/level={j}" for j in k])
    while max_levels is None or level < begun + max_levels:
        if new is None:
            frontier = read([level - 1]).filter("found").select(F.col("id").alias("src"), "rank")
            met = links.join(small(frontier), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("rank", "pos")).alias("at"))
            new = met.join(read(range(level)).select("id"), "id", "left_anti")
        ranked = numbered(new.select("at", "id"), ["at", "id"], "rank", base)
        ranked = ranked.withColumn("found", F.lit(True)) if known is None else ranked.join(known, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
        if max_documents is not None:
            ranked = _cut(ranked, max_documents - documents)
        ranked.select("id", F.lit(level).cast("int").alias("level"), "rank", "found").write.mode("overwrite").parquet(f"{path}/levels/level={level}")
        n, found = read([level]).agg(F.count("*"), F.count_if("found")).first()
        base, documents = base + n, documents + found
        done = found == 0 or (max_documents is not None and documents >= max_documents)
        stop = done or (max_levels is not None and level + 1 >= begun + max_levels)
        if stop or (level + 1) % every == 0:
            put_once(spark, f"{path}/log/{level:06d}.json", {"level": level, "visited": base, "documents": documents, "done": done})
        level, new = level + 1, None
        if done:
            break
    return visited(spark, path)


def _cut(ranked: DataFrame, left: int) -> DataFrame:
    """ranked up to its left-th found row."""
    if left <= 0:
        return ranked.limit(0)
    ranked = staged(ranked, "ranked")
    if ranked.filter("found").count() < left:
        return ranked
    place = numbered(ranked.filter("found").select("rank"), ["rank"], "k").filter(F.col("k") == left).first()["rank"]
    return ranked.filter(F.col("rank") <= place)
