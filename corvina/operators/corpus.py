"""Corpus audit, catalogue, fingerprint, contract of an index, the legal graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.functions.text import has_mojibake
from corvina.shared import small, staged


def audit_profile(docs: DataFrame, source_col: str = "source", text_col: str = "text", short: int = 100) -> DataFrame:
    """One row for each source: counts, empty and short texts, lengths, repeated texts, traces of double decoding."""
    n = F.length(F.coalesce(text_col, F.lit("")))
    base = docs.select(F.col(source_col).alias("source"), n.alias("len"), F.md5(F.coalesce(text_col, F.lit(""))).alias("h"), has_mojibake(F.col(text_col)).alias("bad"))
    # the upper median needs sorted lengths: counts by length first, so a source of any size is as long as its lengths differ
    lengths = base.groupBy("source", "len").agg(F.count("*").alias("n"))
    spread = lengths.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("len", "n"))).alias("s"), F.sum("n").alias("total"))
    middle = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at")),
        lambda a, x: F.struct(
            (a["seen"] + x["n"]).alias("seen"),
            F.when(a["at"].isNull() & (a["seen"] + x["n"] > F.floor(F.col("total") / 2)), x["len"]).otherwise(a["at"]).alias("at"),
        ),
        lambda a: a["at"],
    )
    stats = base.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("len") == 0).alias("n_empty"),
        F.count_if(F.col("len") < short).alias("n_short"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
        F.floor(F.sum("len") / F.count("*")).cast("long").alias("mean_len"),
        F.count_if("bad").alias("n_mojibake"),
        F.floor(100 * F.count_if("bad") / F.count("*")).cast("long").alias("pct_mojibake"),
    )
    different = base.select("source", "h").distinct().groupBy("source").agg(F.count("*").alias("n_texts"))
    return stats.join(spread.select("source", middle.cast("long").alias("median_len")), "source").join(different, "source")


def missing_fields(docs: DataFrame, fields: list[str], source_col: str = "source") -> DataFrame:
    """(source, field, n_missing): rows of each source whose field is null or blank; fields that none lacks have 0."""
    counts = [F.count_if(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "").alias(f) for f in fields]
    wide = docs.groupBy(F.col(source_col).alias("source")).agg(*counts)
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n_missing")) for f in fields))
    return wide.select("source", F.explode(pairs).alias("x")).select("source", "x.*")


def repeated(docs: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(key, n, first_id) of keys that more than one row has."""
    return docs.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).filter("n > 1")


def source_catalogue(fragments: DataFrame, source: Column, catalogue: DataFrame | None = None) -> DataFrame:
    """(source, n) by falling count, with the names of a catalogue (source, nombre) where it has them; empty sources don't show."""
    counts = fragments.groupBy(source.alias("source")).agg(F.count("*").alias("n"))
    if catalogue is not None:
        counts = counts.join(small(catalogue), "source")
    return counts.orderBy(F.desc("n"), "source")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: the first 16 hex digits of the sha256 over the sorted (id, length) list; the contract's exact form.

    It holds one string of all ids in one task, as the contract defines it; fingerprint_tree() is the form for large corpora.
    """
    one = F.struct(F.col(id_col).cast("string").alias("i"), F.length(text_col).cast("string").alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.concat(x["i"], x["n"])), "")
    return docs.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"), F.count("*").alias("n_docs"))


def fingerprint_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaves: int = 4096) -> DataFrame:
    """One row: a two-level hash over (id, length): leaves by hash of the id, then one over the leaves."""
    leaf = F.pmod(F.xxhash64(F.col(id_col)), F.lit(leaves)).alias("leaf")
    h = F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), F.length(text_col).cast("string")), 256)
    parts = docs.groupBy(leaf).agg(
        F.bit_xor(F.conv(F.substring(h, 1, 15), 16, 10).cast("long")).alias("a"),
        F.bit_xor(F.conv(F.substring(h, 16, 15), 16, 10).cast("long")).alias("b"),
        F.count("*").alias("n"),
    )
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("leaf", "a", "b", "n"))), lambda x: F.concat_ws(":", x["leaf"], x["a"], x["b"], x["n"])), ";"
    )
    return parts.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"), F.sum("n").alias("n_docs"))


def pending(fragments: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """What is not indexed yet."""
    return fragments.join(indexed.select(key).distinct(), key, "left_anti")


def superset_violations(indexed_docs: DataFrame, current_docs: DataFrame, key: str) -> DataFrame:
    """Indexed documents that the corpus no longer has; an index may be extended only if there are none."""
    return indexed_docs.select(key).distinct().join(current_docs.select(key), key, "left_anti")


def missing_numbers(present: DataFrame, col: str, low: int, high: int) -> DataFrame:
    spark = present.sparkSession
    wanted = spark.range(low, high + 1).withColumnRenamed("id", col)
    return wanted.join(present.select(F.col(col).cast("long").alias(col)), col, "left_anti")


def broken_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (src, dst) whose dst is no node."""
    return edges.join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti")


def closure(edges: DataFrame, seeds: DataFrame, depth: int, checkpoint_every: int = 4) -> DataFrame:
    """(seed, node, level): what each seed reaches in at most depth steps; each node at its first level.

    Level by level with a left anti join against what was seen, so cycles end; plans are cut every few levels.
    """
    e = edges.select("src", "dst").distinct()
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("level"))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(e, frontier["node"] == e["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("level", F.lit(level))
        if level % checkpoint_every == 0:
            frontier, seen = staged(frontier, "frontier"), staged(seen, "seen")
        seen = seen.unionByName(frontier)
    return seen


def contract_violations(manifest: dict, chunk_mode: str, header: bool, corpus: str) -> list[str]:
    """Why an index may not be extended or searched under these settings."""
    found = []
    for name, value in (("chunk_mode", chunk_mode), ("header", header), ("corpus", corpus)):
        if name in manifest and manifest[name] != value:
            found.append(f"{name}: the index has {manifest[name]!r}, asked for {value!r}")
    return found


def write_manifest(spark: SparkSession, path: str, settings: dict[str, str]) -> None:
    """The settings that an index was built under, as one row beside it; an existing manifest is replaced."""
    rows = [(str(k), str(v)) for k, v in sorted(settings.items())]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(path).collect()}


def guarded_append(fragments: DataFrame, path: str, key: str, settings: dict[str, str]) -> int:
    """Append what the index at path lacks, if its manifest allows these settings and it holds nothing that fragments lack.

    Raises ValueError with the reasons otherwise. Returns how many rows the index has then.
    """
    spark = fragments.sparkSession
    manifest = read_manifest(spark, f"{path}/manifest")
    wrong = [f"{k}: the index has {manifest[k]!r}, asked for {v!r}" for k, v in settings.items() if k in manifest and manifest[k] != str(v)]
    indexed = spark.read.parquet(f"{path}/rows")
    gone = superset_violations(indexed, fragments, key).limit(5).collect()
    if gone:
        wrong.append(f"rows that the corpus no longer has: {[r[key] for r in gone]}")
    if wrong:
        raise ValueError("; ".join(wrong))
    pending(fragments, indexed, key).write.mode("append").parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows").count()


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def eav_pivot(rows: DataFrame, id_col: str, key_col: str, value_col: str, keys: list[str]) -> DataFrame:
    """Entity-attribute-value rows to one row for each entity; the keys are given, so nothing is scanned for them."""
    return rows.groupBy(id_col).pivot(key_col, keys).agg(F.first(value_col, ignorenulls=True))


def graph_totals(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: n_edges, n_broken (whose dst is no node), pct_broken (whole per cent, rounded down)."""
    known = nodes.select(F.col("id").alias("dst")).distinct().withColumn("known", F.lit(True))
    return edges.select("dst").join(known, "dst", "left").agg(
        F.count("*").alias("n_edges"),
        F.count_if(F.col("known").isNull()).alias("n_broken"),
        F.coalesce(F.floor(100 * F.count_if(F.col("known").isNull()) / F.nullif(F.count("*"), F.lit(0))), F.lit(0)).cast("long").alias("pct_broken"),
    )


def bad_dates(docs: DataFrame, date_col: str) -> DataFrame:
    """Rows whose date doesn't begin like an ISO date; null and empty dates are not looked at."""
    return docs.filter((F.coalesce(date_col, F.lit("")) != "") & ~F.col(date_col).rlike(r"^\d{4}-\d{2}-\d{2}"))


def all_sources(tables: list[DataFrame]) -> DataFrame:
    """The sources' tables one after the other, by column names; columns that one lacks are null there."""
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def flattened(docs: DataFrame, metadata: str) -> DataFrame:
    """docs with the fields of a struct column as columns of their own, in its place; columns of docs win over equal names."""
    fields = [f for f in docs.schema[metadata].dataType.names if f not in docs.columns]
    return docs.select(*(c for c in docs.columns if c != metadata), *(F.col(f"{metadata}.{f}").alias(f) for f in fields))


def ordered_union(lists: DataFrame) -> DataFrame:
    """(query_id, doc_id, place) of several lists (query_id, list, rank, doc_id): each id once, where it is first met."""
    first = lists.groupBy("query_id", "doc_id").agg(F.min(F.struct("list", "rank")).alias("m"))
    order = Window.partitionBy("query_id").orderBy("m", "doc_id")
    return first.select("query_id", "doc_id", F.row_number().over(order).alias("place"))


def probe_fragments(fragments: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", least: int = 200) -> DataFrame:
    """(query_id, text) of n fragments of some length in hash order, the first 2,000 characters of each."""
    some = fragments.filter(F.length(text_col) > least).orderBy(F.md5(F.concat(F.lit("probe|"), F.col(id_col).cast("string"))), id_col).limit(n)
    return some.select(F.col(id_col).alias("query_id"), F.substring(text_col, 1, 2000).alias("text"))


def reindex_checks(vectors: DataFrame, lexical: DataFrame, probes: DataFrame, hits: DataFrame, key: str = "doc_id", tolerance: float = 0.01) -> DataFrame:
    """One row after a reindexing: n_vectors, n_lexical, agree (within tolerance), n_probes, n_found: probes found by their own text.

    vectors and lexical: the keys of both halves; probes: (query_id), keys of fragments that were searched by their texts;
    hits: (query_id, doc_id), what that search found.
    """
    counts = vectors.agg(F.count("*").alias("n_vectors")).crossJoin(lexical.select(key).distinct().agg(F.count("*").alias("n_lexical")))
    own = hits.filter(F.col("doc_id") == F.col("query_id")).select("query_id").distinct().withColumn("hit", F.lit(1))
    found = probes.select("query_id").join(own, "query_id", "left").agg(F.count("*").alias("n_probes"), F.count("hit").alias("n_found"))
    agree = F.abs(F.col("n_vectors") - F.col("n_lexical")) <= tolerance * F.col("n_vectors")
    return counts.crossJoin(found).select("n_vectors", "n_lexical", agree.alias("agree"), "n_probes", "n_found")  # one row each
