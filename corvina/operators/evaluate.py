"""Retrieval metrics, paired tests, intervals, sampling, splits, lexicon mining, training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.text import STOP_WORDS, tokens
from corvina.shared import numbered, small

#: Parts of a stratum whose first rows are taken before those of the whole.
SALTS = 64


def hash_order(*cols: Column | str, seed: str = "") -> Column:
    """A reproducible order: md5 of seed and values. DuckDB gives the same."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") if isinstance(c, str) else c for c in cols)))


def first_hits(gold: DataFrame, ranked: DataFrame, depth: int) -> DataFrame:
    """(query_id, hit_rank): the first rank within depth where the fragment is gold or the document is; null without one."""
    same = (ranked["doc_id"] == gold["gold_id"]) | (
        F.coalesce(gold["gold_document"], F.lit("")).cast("string") == F.coalesce(ranked["document"].cast("string"), F.lit("\0"))
    ) & (F.coalesce(gold["gold_document"].cast("string"), F.lit("")) != "")
    found = gold.join(ranked, gold["query_id"] == ranked["query_id"]).filter(same & (ranked["rank"] <= depth))
    best = found.groupBy(gold["query_id"]).agg(F.min("rank").alias("hit_rank"))
    return gold.join(best, "query_id", "left")


def recall(hits: DataFrame, cuts: list[int], mrr_at: int, by: list[str]) -> DataFrame:
    """recall at each cut and MRR, over all and by each column of by, in one pass of grouping sets."""
    r = F.col("hit_rank")
    aggs = [F.count("*").alias("n")]
    aggs += [F.round(F.avg(F.coalesce((r <= k).cast("int"), F.lit(0))), 6).alias(f"recall_{k}") for k in cuts]
    aggs += [F.round(F.avg(F.coalesce(F.when(r <= mrr_at, 1.0 / r), F.lit(0.0))), 6).alias(f"mrr_{mrr_at}")]
    if not by:
        return hits.agg(*aggs)
    sets = [[], *([F.col(c)] for c in by)]
    return hits.groupingSets(sets, *(F.col(c) for c in by)).agg(*aggs)


def mcnemar(pairs: DataFrame) -> DataFrame:
    """(n10, n01, p): discordant pairs of runs (a, b booleans) and the exact two-sided probability."""
    n = pairs.agg(F.count_if(F.col("a") & ~F.col("b")).alias("n10"), F.count_if(~F.col("a") & F.col("b")).alias("n01"))
    total, low = F.col("n10") + F.col("n01"), F.least("n10", "n01")
    # ln C(n, i) by its recurrence, so that long tails neither overflow nor lose their small terms
    start = F.struct((-total * F.log(F.lit(2.0))).alias("l"), F.exp(-total * F.log(F.lit(2.0))).alias("s"))
    tail = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(low, F.lit(1))),
        start,
        lambda a, i: F.when(
            i <= low,
            F.struct(
                (a["l"] + F.log((total - i + 1) / i)).alias("l"), (a["s"] + F.exp(a["l"] + F.log((total - i + 1) / i))).alias("s")
            ),
        ).otherwise(a),
        lambda a: a["s"],
    )
    return n.withColumn("p", F.round(F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)), 6))


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, reps: int = 2000, low: int = 50, high: int = 1949) -> DataFrame:
    """(low, high): positions of the sorted means of reps resamples of whole clusters.

    A draw is the cluster at the position that the md5 of (rep, draw) names, so any engine draws the same ones. Clusters are
    pre-aggregated; draws are reps times the number of clusters, dealt by rep.
    """
    sums = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    placed = numbered(sums, [cluster], "pos", 0)
    size = placed.agg(F.count("*").alias("m"))
    draws = rows.sparkSession.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(size))  # one row
    draws = draws.select("rep", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("draw"))
    word = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    taken = draws.withColumn("pos", word % F.col("m")).join(small(placed.select("pos", "s", "n")), "pos")
    means = taken.groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("mean"))
    ordered = means.agg(F.array_sort(F.collect_list("mean")).alias("v"))  # reps numbers
    return ordered.select(F.round(F.col("v")[low], 6).alias("low"), F.round(F.col("v")[high], 6).alias("high"))


def abstention_curve(scored: DataFrame, score: str, correct: str, thresholds: list[float]) -> DataFrame:
    """(threshold, coverage, precision) for given thresholds, in one pass."""
    total = scored.agg(F.count("*").alias("total"))
    each = scored.select(F.col(score).alias("s"), F.col(correct).cast("int").alias("c"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    kept = each.filter(F.col("s") >= F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("n"), F.sum("c").alias("good"))
    return kept.crossJoin(F.broadcast(total)).select(
        "threshold", F.round(F.col("n") / F.col("total"), 6).alias("coverage"), F.round(F.col("good") / F.col("n"), 6).alias("precision")
    )


def best_coverage(curve: DataFrame, levels: list[float]) -> DataFrame:
    """The widest coverage whose precision reaches each level."""
    each = curve.select("*", F.explode(F.array(*map(F.lit, levels))).alias("level")).filter(F.col("precision") >= F.col("level"))
    return each.groupBy("level").agg(F.max("coverage").alias("coverage"))


def stratified_sample(docs: DataFrame, stratum: str, id_col: str, quotas: dict[str, int], seed: str = "") -> DataFrame:
    """The first quota rows of each stratum in hash order.

    The first of each of SALTS parts of a stratum are taken before those of the whole, so no task sorts a whole stratum.
    """
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col(stratum)]
    rows = docs.filter(F.col(stratum).isin(list(quotas))).withColumns({"_h": hash_order(id_col, seed=seed), "_salt": F.pmod(F.xxhash64(id_col), F.lit(SALTS))})
    for keys in ([stratum, "_salt"], [stratum]):
        order = Window.partitionBy(*keys).orderBy("_h", id_col)
        rows = rows.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= quota)
    return rows.drop("_h", "_salt")


def split_by_document(rows: DataFrame, document: str, test_share: float = 0.4, seed: str = "") -> DataFrame:
    """rows with part: all rows of a document are on one side; about test_share of the documents are test."""
    word = F.conv(F.substring(hash_order(document, seed=seed), 1, 8), 16, 10).cast("double")
    return rows.withColumn("part", F.when(word / float(1 << 32) < test_share, "test").otherwise("dev"))


def content_terms(text: Column) -> Column:
    """Different terms of over three characters that are no stop words."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 3) & ~F.array_contains(stop, t)))


def pmi_lexicon(pairs: DataFrame, background: DataFrame, least: int = 4, top: int = 4) -> DataFrame:
    """(term, legal, score, rank) from pairs (query, positive): what answers say when a word is asked, by PMI * ln(1 + n).

    background: (text), for the document frequencies. Terms under least occurrences go before the pairs are joined to them.
    """
    docs = background.select(content_terms(F.col("text")).alias("w"))
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    df = docs.select(F.explode("w").alias("legal")).groupBy("legal").agg(F.count("*").alias("df")).filter(F.col("df") >= least)
    both = pairs.select(content_terms(F.col("query")).alias("q"), content_terms(F.col("positive")).alias("p"))
    asked = both.select(F.explode("q").alias("term")).groupBy("term").agg(F.count("*").alias("times")).filter(F.col("times") >= least)
    met = both.select(F.explode("q").alias("term"), F.array_except("p", "q").alias("p")).join(asked.select("term"), "term", "left_semi")
    joint = met.select("term", F.explode("p").alias("legal")).groupBy("term", "legal").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    scored = joint.join(asked, "term").join(df, "legal").crossJoin(F.broadcast(n_docs))
    pmi = F.log((F.col("n") / F.col("times")) / (F.col("df") / F.col("n_docs")))
    kept = scored.withColumn("pmi", pmi).filter("pmi > 0").withColumn("score", F.round(F.col("pmi") * F.log(1 + F.col("n")), 6))
    order = Window.partitionBy("term").orderBy(F.desc("score"), F.desc("legal"))
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("term", "legal", "score", "rank")


def expanded_terms(queries: DataFrame, bridge: dict[str, tuple[str, ...]]) -> DataFrame:
    """queries (query_id, terms) with the bridge's words for them behind, each once."""
    table = F.create_map(*(F.lit(x) for k, v in bridge.items() for x in (k, " ".join(v))))
    added = F.filter(
        F.split(F.array_join(F.transform("terms", lambda t: F.coalesce(table[t], F.lit(""))), " "), " +"), lambda w: w != ""
    )
    return queries.withColumn("terms", F.array_distinct(F.concat("terms", added)))


def hard_negatives(gold: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """The first n candidates of each query that are neither the gold fragment nor of its document."""
    found = ranked.join(gold, "query_id").filter((F.col("doc_id") != F.col("gold_id")) & (F.col("document") != F.col("gold_document")))
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= n).select("query_id", "doc_id", "pick")


def training_pairs(questions: DataFrame, gold: DataFrame, ranked: DataFrame, fragments: DataFrame, n: int = 4, most_chars: int = 2000) -> DataFrame:
    """(query_id, query, positive, negatives): questions (query_id, query) with the text of their gold fragment and of the first n
    hard negatives, each up to most_chars; questions without a negative or whose gold fragment has no text go.

    fragments: (doc_id, text). A text is fetched for the fragments that are named, and joined by their ids.
    """
    negatives = hard_negatives(gold, ranked, n)
    wanted = negatives.select("query_id", "doc_id", "pick").unionByName(gold.select("query_id", F.col("gold_id").alias("doc_id"), F.lit(0).alias("pick")))
    texts = fragments.select("doc_id", F.substring("text", 1, most_chars).alias("t")).join(wanted, "doc_id")
    sets = texts.groupBy("query_id").agg(
        F.max(F.when(F.col("pick") == 0, F.col("t"))).alias("positive"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("pick") > 0, F.struct("pick", F.coalesce("t", F.lit("")).alias("t"))))), lambda x: x["t"]).alias("negatives"),
    )  # n + 1 texts a question
    return questions.join(sets.filter((F.length("positive") > 0) & (F.size("negatives") > 0)), "query_id").select("query_id", "query", "positive", "negatives")


def clean_negatives(triples: DataFrame, share: float = 0.95) -> DataFrame:
    """triples (query_id, positive_score, negatives: array<struct<id, score>>): negatives that score like the positive go."""
    bar = F.when(F.col("positive_score") > 0, F.col("positive_score") * share).otherwise(F.col("positive_score") / share)
    return triples.withColumn("negatives", F.filter("negatives", lambda x: x["score"] < bar)).filter(F.size("negatives") > 0)


def circular_pairs(rows: DataFrame, id_col: str, shift: int = 3) -> DataFrame:
    """Each row with the one shift places on, around the end."""
    placed = numbered(rows.select(F.col(id_col).alias("id")), ["id"], "pos", 0)
    n = placed.agg(F.count("*").alias("n"))
    other = placed.select(F.col("id").alias("other"), F.col("pos").alias("opos"))
    asked = placed.crossJoin(F.broadcast(n))  # one row
    return asked.join(other, F.col("opos") == (F.col("pos") + shift) % F.col("n")).select("id", "other")
