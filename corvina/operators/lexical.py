"""Inverted index and BM25 over batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.functions.text import query_terms, tokens
from corvina.shared import small, staged

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Postings of a block of the stored index.
BLOCK = 128
#: Terms of a batch that are told to the scan as a list at most.
LISTED = 10_000
#: Postings of a batch's terms from which on blocks are skipped by their bounds: below, looking costs more than it saves.
PRUNE_FROM = 5_000_000
BLOCK_COLUMNS = ("bucket", "term", "block", "n", "max_tf", "min_dl", "doc_ids", "dls", "tfs")
TOTALS = "n long, tokens long, buckets int, segment long"


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, tf): occurrences are counted on the map side before they are dealt by term."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df): each document emits a term once, so nothing is shuffled but partial sums."""
    each = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _part(tf, dl, avgdl) -> Column:
    """What an occurrence count contributes, before the term's weight: it grows with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def write_index(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, buckets: int | None = None
) -> None:
    """A segment of an inverted index under path; further calls add segments (insert), optimize_index() makes them one.

    postings: blocks of up to BLOCK postings of one term and one value of the keep columns, the weightiest first, with the
    bounds of their counts; the hash bucket of the term is the partition column, so a batch of queries reads its own buckets,
    and the blocks are sorted by term, so row groups are skipped too. terms (term, df) lie in the same buckets. totals (n,
    tokens, buckets, segment): a row for each segment. The texts are tokenised once; totals are counted from the written
    table, so tasks that run again count once. buckets: of a new index; by default one for a few million postings.
    """
    keep, spark = keep or [], docs.sparkSession
    w = docs.select(F.col(id_col).alias("doc_id"), *keep, tokens(F.col(text_col)).alias("w"))
    # no token is empty: the empty term stands for the document itself
    each = w.select("doc_id", *keep, F.size("w").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "w")).alias("term"))
    found = each.groupBy("term", "doc_id", *keep, "dl").agg(F.count("*").cast("int").alias("tf"))
    rows = staged(found, "postings")
    before = _totals(spark, path)
    n, tokens_ = rows.filter("term = ''").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    rows = rows.filter("term <> ''")
    buckets = (before["buckets"] if before else None) or buckets or max(16, min(4096, rows.count() // 4_000_000 + 1))
    segment = before["segments"] if before else 0
    _write_blocks(rows, f"{path}/postings", keep, buckets, segment, "append")
    _write_terms(rows.groupBy("term").agg(F.count("*").alias("df")), f"{path}/terms", buckets, "append")
    spark.createDataFrame([(n, tokens_, buckets, segment)], TOTALS).write.mode("append").parquet(f"{path}/totals")


def _totals(spark: SparkSession, path: str) -> dict | None:
    """n, tokens, buckets and segments of the index at path, or None where there is none."""
    try:
        rows = spark.read.schema(TOTALS).parquet(f"{path}/totals")
        return rows.agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.max("buckets").alias("buckets"), (F.max("segment") + 1).alias("segments")).first().asDict()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _write_terms(terms: DataFrame, path: str, buckets: int, mode: str) -> None:
    dealt = terms.withColumn("bucket", _bucket(buckets)).repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term")
    dealt.write.mode(mode).partitionBy("bucket").parquet(path)


def _write_blocks(rows: DataFrame, path: str, keep: list[str], buckets: int, segment: int, mode: str) -> None:
    """rows (term, doc_id, keep, dl, tf) as blocks; ranges go on inside a term, so the commonest word is dealt out as well."""
    impact = (F.col("tf") / (F.col("tf") + F.col("dl") / 256 + 1)).cast("float")  # about the order of the contributions, at any average length
    order = ["bucket", "term", *keep, "impact", "doc_id"]
    ranged = rows.withColumns({"bucket": _bucket(buckets), "impact": -impact}).repartitionByRange(*order).sortWithinPartitions(*order)
    key = ["bucket", "term", *keep]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(
        [f"{c} {types.get(c, 'int')}" for c in key]
        + [f"block long, n int, max_tf int, min_dl int, doc_ids array<{types['doc_id']}>, dls array<int>, tfs array<int>"]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = (segment << 44) | (TaskContext.get().partitionId() << 24)
        for x in batches:
            if not x.num_rows:
                continue
            new = np.zeros(x.num_rows, dtype=bool)
            for c in key:
                new[1:] |= ~np.array(pc.equal(pc.fill_null(x.column(c).slice(1).cast(pa.string()), "\0"), pc.fill_null(x.column(c).slice(0, x.num_rows - 1).cast(pa.string()), "\0")))
            new[0] = True
            run = np.flatnonzero(new)
            place = np.arange(x.num_rows) - np.repeat(run, np.diff(np.append(run, x.num_rows)))
            first = np.flatnonzero(place % BLOCK == 0)
            offsets = pa.array(np.append(first, x.num_rows), pa.int32())
            tf, dl = x.column("tf").to_numpy(), x.column("dl").to_numpy()
            columns = [x.column(c).take(pa.array(first)) for c in key]
            columns += [pa.array(serial + np.arange(len(first))), pa.array(np.diff(np.append(first, x.num_rows)), pa.int32())]
            columns += [pa.array(np.maximum.reduceat(tf, first), pa.int32()), pa.array(np.minimum.reduceat(dl, first), pa.int32())]
            columns += [pa.ListArray.from_arrays(offsets, x.column(c)) for c in ("doc_id", "dl", "tf")]
            serial += len(first)
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "block", "n", "max_tf", "min_dl", "doc_ids", "dls", "tfs"])

    blocks = ranged.drop("impact").mapInArrow(cut, schema)
    blocks.write.mode(mode).partitionBy("bucket").parquet(path)


def _opened(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """(term, doc_id, keep, dl, tf) of blocks, with the block's query_id where it has one."""
    more = [c for c in ("query_id", "weight") if c in blocks.columns]
    zipped = blocks.select("term", *keep, *more, F.explode(F.arrays_zip("doc_ids", "dls", "tfs")).alias("x"))
    return zipped.select("term", *keep, *more, F.col("x.doc_ids").alias("doc_id"), F.col("x.dls").alias("dl"), F.col("x.tfs").alias("tf"))


def stored_postings(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, keep, dl, tf): the postings of the index at path, one a row."""
    blocks = spark.read.parquet(f"{path}/postings")
    return _opened(blocks, [c for c in blocks.columns if c not in BLOCK_COLUMNS])


def indexed_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id) of the documents that the index at path has postings of."""
    return spark.read.parquet(f"{path}/postings").select(F.explode("doc_ids").alias("doc_id")).distinct()


def optimize_index(spark: SparkSession, path: str, target: str) -> None:
    """The segments of path as one, under target: postings in new blocks, term and corpus totals summed."""
    blocks = spark.read.parquet(f"{path}/postings")
    keep = [c for c in blocks.columns if c not in BLOCK_COLUMNS]
    whole = _totals(spark, path)
    _write_blocks(_opened(blocks, keep), f"{target}/postings", keep, whole["buckets"], 0, "overwrite")
    terms = spark.read.parquet(f"{path}/terms").groupBy("term").agg(F.sum("df").alias("df"))
    _write_terms(terms, f"{target}/terms", whole["buckets"], "overwrite")
    spark.createDataFrame([(whole["n"], whole["tokens"], whole["buckets"], 0)], TOTALS).write.mode("overwrite").parquet(f"{target}/totals")


def query_table(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term) of the useful terms."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(query_terms(F.col(text_col))).alias("term"))


def _weighted(queries: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """(query_id, term, weight) of the terms of queries that documents have; df: (term, df)."""
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    return queries.join(df, "term").select("query_id", "term", idf.alias("weight"))


def _summed(hits: DataFrame, avgdl: float, keep: list[str]) -> DataFrame:
    """(query_id, doc_id, keep, score) of hits (query_id, weight, doc_id, keep, dl, tf)."""
    return hits.groupBy("query_id", "doc_id", *keep).agg(F.round(F.sum(F.col("weight") * _part(F.col("tf"), F.col("dl"), avgdl)), 6).alias("score"))


def _ranked(scored: DataFrame, top: int | None) -> DataFrame:
    if top is None:
        return scored
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def bm25(
    docs: DataFrame, queries: DataFrame, top: int | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """(query_id, doc_id, score, rank) of the best documents of each query; queries: (query_id, term).

    For documents without an index: they are tokenised once, tokens are filtered by the batch's terms before anything is
    shuffled, and the postings of those terms alone are kept; the corpus totals come from the same table, once written.
    Scores are rounded to six places before ranking; ties go to the smaller id.
    """
    keep = keep or []
    queries = staged(queries, "query-terms")
    toks = docs.select(F.col(id_col).alias("doc_id"), *keep, tokens(F.col(text_col)).alias("w"))
    each = toks.select("doc_id", *keep, F.size("w").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "w")).alias("term"))
    wanted = queries.select("term").union(queries.sparkSession.createDataFrame([("",)], "term string")).distinct()
    hits = each.join(small(wanted), "term", "left_semi").groupBy("doc_id", *keep, "dl", "term").agg(F.count("*").alias("tf"))
    hits = staged(hits, "hits")
    n, tokens_ = hits.filter("term = ''").agg(F.count("*"), F.sum("dl")).first()
    hits = hits.filter("term <> ''")
    asked = _weighted(queries, hits.groupBy("term").agg(F.count("*").alias("df")), n)
    return _ranked(_summed(hits.join(small(asked), "term"), tokens_ / n if n else 0.0, keep), top)


def bm25_index(
    spark: SparkSession, path: str, queries: DataFrame, top: int | None, keep: list[str] | None = None, sources: list[str] | None = None,
    prune_from: int = PRUNE_FROM,
) -> DataFrame:
    """As bm25(), from what write_index() wrote under path; no text is read.

    Up to LISTED terms of the batch are told to the scan: only their buckets are read, and of those the row groups that may
    have the terms; more are joined. If the batch's terms have over prune_from postings, a top is searched in two steps: the
    weightiest blocks of each term give a score that top documents of a query surely reach, and blocks whose bound, with the
    best of the query's other terms, lies under it are never opened. The rows are the same.
    sources: only blocks of these (the index must carry the column source) are opened; term and corpus statistics stay those
    of the whole index.
    """
    queries, keep = staged(queries, "query-terms"), keep or []
    whole = _totals(spark, path)
    n, avgdl = whole["n"], whole["tokens"] / whole["n"] if whole["n"] else 0.0
    asked = queries.select("term").distinct().withColumn("bucket", _bucket(whole["buckets"]))
    few = asked.limit(LISTED + 1).collect()

    def those(table: DataFrame) -> DataFrame:
        if len(few) <= LISTED:
            return table.filter(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("term").isin(sorted({r["term"] for r in few})))
        return table.join(small(asked), ["bucket", "term"], "left_semi")

    df = those(spark.read.parquet(f"{path}/terms")).groupBy("term").agg(F.sum("df").alias("df"))
    asked_of = staged(_weighted(queries, df, n), "weights")
    blocks = those(spark.read.parquet(f"{path}/postings"))
    blocks = blocks.filter(F.col("source").isin(sources)) if sources else blocks
    if top is None or (df.agg(F.sum("df")).first()[0] or 0) <= prune_from:
        chosen = blocks.join(small(asked_of), "term")
    else:
        chosen = blocks.join(small(_needed(blocks, asked_of, top, avgdl, keep)), ["term", "block"])
    return _ranked(_summed(_opened(chosen, keep), avgdl, keep), top)


def _needed(blocks: DataFrame, asked: DataFrame, top: int, avgdl: float, keep: list[str]) -> DataFrame:
    """(query_id, term, weight, block): the blocks that may hold one of a query's top documents.

    Opening only a part of the blocks gives every document a score that it reaches at least, so the top-th best of those is a
    bar that the true top documents pass. A document of a block has at most the block's bound and, for each other term of the
    query, that term's best bound.
    """
    bounds = blocks.select("term", "block", "n", _part(F.col("max_tf"), F.col("min_dl"), avgdl).alias("bound"))
    of = bounds.join(small(asked), "term").withColumn("bound", F.col("weight") * F.col("bound"))
    of = staged(of, "bounds")
    first = Window.partitionBy("query_id", "term").orderBy(F.desc("bound"), "block")
    heads = of.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= max(4, -(-4 * top // BLOCK))).select("query_id", "term", "weight", "block")
    partial = _summed(_opened(blocks.join(small(heads), ["term", "block"]), keep), avgdl, keep)
    bars = _ranked(partial, top).filter(F.col("rank") == top).select("query_id", F.col("score").alias("bar"))
    best = of.groupBy("query_id", "term").agg(F.max("bound").alias("best"))
    total = best.groupBy("query_id").agg(F.sum("best").alias("total"))
    limits = best.join(total, "query_id").join(bars, "query_id", "left").select("query_id", "term", (F.col("bar") - F.col("total") + F.col("best") - 2e-6).alias("least"))
    kept = of.join(small(limits), ["query_id", "term"]).filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    return staged(kept.select("query_id", "term", "weight", "block"), "needed")


def df_band_terms(
    queries: DataFrame, stats: DataFrame, n_docs: DataFrame, min_df: int = 5, max_share: float = 0.25, cap: int = 12
) -> DataFrame:
    """Terms of each query whose document frequency lies in a band, rarest first, at most cap. n_docs: one row (n)."""
    found = queries.join(stats, "term").join(F.broadcast(n_docs)).filter(
        (F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n"))
    )
    order = Window.partitionBy("query_id").orderBy("df", "term")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap).select("query_id", "term", "df", "rank")


def oversampled(ranked: DataFrame, source_col: str, sources: list[str], k: int) -> DataFrame:
    """Parity mode: the source filter acts after a cut at 24 k, and keeps 3 k."""
    order = Window.partitionBy("query_id").orderBy("rank")
    inside = ranked.filter((F.col("rank") <= 24 * k) & F.col(source_col).isin(sources))
    return inside.withColumn("kept_rank", F.row_number().over(order)).filter(F.col("kept_rank") <= 3 * k)
