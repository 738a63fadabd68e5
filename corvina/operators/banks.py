"""Question banks and runs over them: integrity, splits, sampling, comparisons, training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.text import quoted
from corvina.operators.evaluate import hash_order
from corvina.shared import numbered, small, staged

# Kinds of cases with and without an anchor in the corpus.
ANCHORED = ("responde", "solo_referencia", "trampa_derogada", "responde_no_recuperado")
NOT_ANCHORED = ("no_cubierto", "trampa_ambito")
#: Sampled fragments have so many characters.
SAMPLE_LENGTHS = (300, 1800)


def sample_gate(text: Column, lengths: tuple[int, int] = SAMPLE_LENGTHS) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).between(*lengths)


def rejection_sample(fragments: DataFrame, id_col: str, text_col: str, n: int, seed: str = "") -> DataFrame:
    """n fragments of a usable length, without replacement, in hash order; one of each id."""
    usable = fragments.filter(sample_gate(F.col(text_col))).dropDuplicates([id_col])
    return usable.orderBy(hash_order(id_col, seed=seed), id_col).limit(n)


def bank_violations(
    cases: DataFrame, fragments: DataFrame, anchored: tuple[str, ...] = ANCHORED, without: tuple[str, ...] = NOT_ANCHORED
) -> DataFrame:
    """(case_id, problem) of a bank. cases: (case_id, tipo, fragmento_id, documento_id, cita_esperada); fragments: (id, texto).

    Problems: repeated id; an anchor or a citation where there must be none; unknown kind; no anchor; a document that is no
    prefix of its fragment; an anchor that doesn't exist; no citation; a citation that is not literally there.
    """
    own = Window.partitionBy("case_id")
    texts = fragments.select(F.col("id").alias("_f"), F.col("texto").alias("_t"))
    anchors = cases.select(F.col("fragmento_id").alias("_f")).filter("_f is not null").distinct()
    texts = texts.join(small(anchors), "_f", "left_semi")
    rows = cases.withColumn("_n", F.count("*").over(own)).withColumn("_f", F.col("fragmento_id")).join(texts, "_f", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    bare, due = F.col("tipo").isin(*without), F.col("tipo").isin(*anchored)
    with_anchor = due & has("fragmento_id")
    there = with_anchor & F.col("_t").isNotNull()
    literal = F.contains(quoted(F.col("_t")), quoted(F.col("cita_esperada")))
    checks = {
        "repeated": F.col("_n") > 1,
        "anchor_not_allowed": bare & (has("fragmento_id") | has("documento_id")),
        "citation_not_allowed": bare & has("cita_esperada"),
        "unknown_kind": ~F.coalesce(bare | due, F.lit(False)),
        "no_anchor": due & ~has("fragmento_id"),
        "no_prefix": with_anchor & has("documento_id") & ~F.startswith("fragmento_id", F.col("documento_id")),
        "anchor_missing": with_anchor & F.col("_t").isNull(),
        "no_citation": there & ~has("cita_esperada"),
        "citation_not_literal": there & has("cita_esperada") & ~literal,
    }
    found = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()))
    return rows.select("case_id", F.explode(F.array_compact(found)).alias("problem")).distinct()


def split_by_profile(cases: DataFrame, profile: str, document: str, seed: str = "2026") -> DataFrame:
    """(document, part): half of each profile's documents in hash order are dev; of several profiles the first one decides."""
    each = cases.select(F.col(profile).alias("_p"), F.col(document).alias("_d")).distinct().withColumn("_h", hash_order("_d", seed=seed))
    placed = numbered(each, ["_p", "_h", "_d"], "_i")  # a profile is a run of numbers
    runs = placed.groupBy("_p").agg(F.min("_i").alias("_from"), F.count("*").alias("_n"))
    inside = F.col("_i") - F.col("_from") < F.floor(F.col("_n") / 2)
    dealt = placed.join(small(runs.withColumnRenamed("_p", "_q")), F.col("_p").eqNullSafe(F.col("_q"))).withColumn("part", F.when(inside, "dev").otherwise("test"))
    # the profile with a dev place first, as dev documents of a profile are assigned before its test ones
    return dealt.groupBy(F.col("_d").alias(document)).agg(F.min_by("part", F.struct("_p", "part")).alias("part"))


def split_leaks(rows: DataFrame, part: str, document: str) -> DataFrame:
    """Documents that are on both sides of a split."""
    side = lambda name: rows.filter(F.col(part) == name).select(document)
    return side("dev").intersect(side("test"))


def first_of_profile(cases: DataFrame, profile: str, order: str, n: int) -> DataFrame:
    """The first n cases of each profile."""
    w = Window.partitionBy(profile).orderBy(order)
    return cases.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b) of two runs over one bank. Raises unless both have the same cases, each once."""
    counts = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(key, F.lit(0), F.lit(1))).groupBy(key)
    wrong = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a <> 1 or b <> 1").limit(5).collect()
    if wrong:
        raise ValueError(f"the runs don't have the same cases: {[r[key] for r in wrong]}")
    return a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)


def with_details(details: DataFrame, bank: DataFrame, key: str) -> DataFrame:
    """Details with what the bank says of their query; queries that the bank lacks keep nulls."""
    return details.join(bank, key, "left")


def anchor_wins(base: DataFrame, other: DataFrame, anchor: str, hit: str) -> DataFrame:
    """One row: anchors on which other has more hits than base, or fewer, and all anchors of base."""
    sums = lambda x, name: x.groupBy(anchor).agg(F.sum(F.col(hit).cast("int")).alias(name))
    both = sums(base, "b").join(sums(other, "o"), anchor, "left").withColumn("o", F.coalesce("o", F.lit(0)))
    return both.agg(F.count_if(F.col("o") > F.col("b")).alias("better"), F.count_if(F.col("o") < F.col("b")).alias("worse"), F.count("*").alias("anchors"))


def coverage_by_seed(rows: DataFrame, seed: str, covered: str, least: int = 3, best: int = 10, worst: int = 12) -> DataFrame:
    """(seed, n, covered, share, best, worst): seeds of at least so many rows, the best covered and the worst ones."""
    sums = rows.groupBy(F.col(seed).alias("seed")).agg(F.count("*").alias("n"), F.sum(F.col(covered).cast("int")).alias("covered"))
    sums = sums.filter(F.col("n") >= least).withColumn("share", F.round(F.col("covered") / F.col("n"), 6))
    up, down = sums.orderBy(F.desc("share"), "seed").limit(best), sums.orderBy("share", F.desc("seed")).limit(worst)
    both = up.withColumn("k", F.lit("best")).unionByName(down.withColumn("k", F.lit("worst")))
    return both.groupBy("seed", "n", "covered", "share").agg(F.bool_or(F.col("k") == "best").alias("best"), F.bool_or(F.col("k") == "worst").alias("worst"))


def retriever_contribution(gold: DataFrame, vector: DataFrame, lexical: DataFrame, fused: DataFrame, depth: int = 50, k: int = 5) -> DataFrame:
    """One row: where the gold document is found. gold: (query_id, document); lists: (query_id, document, rank).

    in_top, near (in a list but not in the first k of the fused one), nowhere, and only_lexical, only_vector.
    """
    out = gold.select("query_id", "document")
    for name, x, n in (("v", vector, depth), ("l", lexical, depth), ("f", fused, k)):
        best = x.filter(F.col("rank") <= n).join(small(gold.select("query_id", "document")), ["query_id", "document"], "left_semi")
        out = out.join(best.groupBy("query_id").agg(F.min("rank").alias(name)), "query_id", "left")
    v, le, f = (F.col(c).isNotNull() for c in "vlf")
    return out.agg(
        F.count("*").alias("n"), F.count_if(f).alias("in_top"), F.count_if(~f & (v | le)).alias("near"), F.count_if(~f & ~v & ~le).alias("nowhere"),
        F.count_if(le & ~v).alias("only_lexical"), F.count_if(v & ~le).alias("only_vector"),
    )


def ceiling(hits: DataFrame, depths: list[int]) -> DataFrame:
    """(depth, share): the share of queries whose gold is among so many candidates; hits: (query_id, hit_rank or null)."""
    each = hits.select("hit_rank", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
    return each.groupBy("depth").agg(F.round(F.avg(F.coalesce((F.col("hit_rank") <= F.col("depth")).cast("int"), F.lit(0))), 6).alias("share"))


def judge_agreement(verdicts: DataFrame, judge: str, human: str) -> DataFrame:
    """One row: n (both said something), agreement, precision of the judge's yes, recall of the human's yes."""
    both = verdicts.filter(F.col(judge).isNotNull() & F.col(human).isNotNull())
    j, h = F.col(judge).cast("boolean"), F.col(human).cast("boolean")
    part = lambda a, b: F.round(F.count_if(a & b) / F.nullif(F.count_if(a), F.lit(0)), 6)
    return both.agg(F.count("*").alias("n"), F.round(F.avg((j == h).cast("int")), 6).alias("agreement"), part(j, h).alias("precision"), part(h, j).alias("recall"))


def same_top(a: DataFrame, b: DataFrame, ks: list[int]) -> DataFrame:
    """(k, n, same): queries whose first k results are the same in the same order; lists: (query_id, doc_id, rank)."""
    tops = []
    for x, name in ((a, "a"), (b, "b")):
        rows = x.filter(F.col("rank") <= max(ks)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
        tops.append(rows.select("query_id", F.transform("r", lambda s: s["doc_id"]).alias(name)))
    both = tops[0].join(tops[1], "query_id", "full").select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    same = F.slice("a", F.lit(1), F.col("k")).eqNullSafe(F.slice("b", F.lit(1), F.col("k")))
    return both.groupBy("k").agg(F.count("*").alias("n"), F.count_if(same).alias("same"))


def _places(x: DataFrame, name: str) -> DataFrame:
    """x (name, source, pos) with its place when all rows are laid out by source and position; only one row a source is sorted whole."""
    sizes = x.groupBy("source").agg(F.count("*").alias("n"))
    before = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("source").orderBy("pos", name)) - 1
    return x.withColumn("_i", own).join(bases, "source").select(name, F.col("source").alias(f"{name}_source"), (F.col("base") + F.col("_i")).alias("place"))


def negative_pairs(fragments: DataFrame, questions: DataFrame, rounds: int = 3) -> DataFrame:
    """(fragment, question): each fragment with a question of another source as far as that goes, each question once.

    fragments: (fragment, source, pos), questions: (question, source, pos). Both are laid out by source, and the questions
    are shifted past their largest source, so that places meet other sources; what met its own source is laid out anew in
    the next round. What is left after the rounds is paired whatever its source, until either side is used up.
    """
    f, q, found = fragments.select("fragment", "source", "pos"), questions.select("question", "source", "pos"), []
    for k in range(rounds + 1):
        shape = q.groupBy("source").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(1)).alias("all"))
        place = F.pmod(F.col("place") - (F.col("most") if k < rounds else F.lit(0)), F.col("all"))
        shifted = _places(q, "question").crossJoin(F.broadcast(shape)).withColumn("place", place)  # one row
        pairs = _places(f, "fragment").join(shifted, "place")
        pairs = pairs.filter("fragment_source <> question_source") if k < rounds else pairs
        found.append(staged(pairs.select("fragment", "question"), "pairs"))
        f, q = f.join(found[-1], "fragment", "left_anti"), q.join(found[-1], "question", "left_anti")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def multi_fragment_dataset(questions: DataFrame, ranked: DataFrame, n: int = 5, deep: int = 8, least: int = 3) -> DataFrame:
    """(query_id, kind, fragments): questions (query_id, document) with what search found, ranked (query_id, doc_id, document, rank).

    positive: the first n results, if the question's own document is among them; negative: the first n of deep results that
    are of other documents, if there are least of them.
    """
    found = ranked.filter(F.col("rank") <= deep).join(questions.withColumnRenamed("document", "own"), "query_id")
    top, other = F.col("rank") <= n, F.col("document") != F.col("own")
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("rank", "doc_id")))), lambda x: x["doc_id"])
    sets = found.groupBy("query_id").agg(ids(top).alias("p"), F.bool_or(top & ~other).alias("there"), F.slice(ids(other), 1, n).alias("d"))
    kinds = F.array(
        F.when(F.coalesce("there", F.lit(False)), F.struct(F.lit("positive").alias("kind"), F.col("p").alias("fragments"))),
        F.when(F.size("d") >= least, F.struct(F.lit("negative").alias("kind"), F.col("d").alias("fragments"))),
    )
    return sets.select("query_id", F.explode(F.array_compact(kinds)).alias("x")).select("query_id", "x.kind", "x.fragments")
