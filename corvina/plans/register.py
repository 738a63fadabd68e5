"""The registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import text as tx
from corvina.operators import chunking, corpus, evaluate, fusion, grounding, lexical, routing, usage, validity, vector
from corvina.session import table
from corvina.shared import shared_dir, small, spread, staged
from corvina.sources import connectors
from corvina.streaming import quota

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
STOP = "[" + ",".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def toks(col: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({col})), '[\p{{L}}\p{{N}}_]+')"


def qterms(col: str) -> str:
    """A query's terms in SQL: different useful tokens in order of their first place, twelve at most."""
    f = f"list_filter({toks(col)}, lambda t: length(t) >= 3 AND NOT list_contains({STOP}, t))"
    return f"list_filter({f}, lambda t, i: list_position({f}, t) = i)[1:12]"


DOCS_T = f"d AS (SELECT doc_id, source, {toks('text')} AS w FROM documents)"


def bm25_sql(queries: str, docs: str = DOCS_T) -> str:
    """CTEs up to scored(query_id, doc_id, score, rank); queries: a CTE q(query_id, term)."""
    return f"""WITH {docs}, {queries},
    c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
    t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d),
    h AS (SELECT doc_id, dl, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    s AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    p AS (SELECT q.query_id, h.doc_id,
        greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part
        FROM h JOIN s USING (term) JOIN q USING (term), c),
    scored AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM p GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
"""


BENCH_Q = f"q AS (SELECT item_id AS query_id, unnest({qterms('text')}) AS term FROM benchmark)"
ONE = "the licensed version of the text and an erhea thing with oned"
ONE_Q = f"q AS (SELECT 1 AS query_id, unnest({qterms(f'$q${ONE}$q$')}) AS term)"
KNN_SQL = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0),
    x AS (SELECT query_id, vec_id, {d} AS distance FROM v, q {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM x)
"""
L2 = "round(list_sum(list_transform(list_zip(e, qe), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)"
COS = "greatest(0.0, round(1 - list_sum(list_transform(list_zip(e, qe), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(e, lambda z: z * z))) * sqrt(list_sum(list_transform(qe, lambda z: z * z)))), 6))"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def bench_terms(spark: SparkSession, d: str) -> DataFrame:
    return lexical.query_table(table(spark, d, "benchmark"), "item_id", "text")


def one_query(spark: SparkSession) -> DataFrame:
    return lexical.query_table(spark.createDataFrame([(1, ONE)], "query_id int, text string"), "query_id", "text")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


# --- text ------------------------------------------------------------------


@query(f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_terms FROM (SELECT doc_id, {toks('text')} AS w FROM documents)")
def tokenize_terms(spark, d):
    w = tx.tokens(F.col("text"))
    return docs(spark, d).select("doc_id", w.alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_terms")
    )


@query(f"SELECT item_id, array_to_string({qterms('text')}, ' ') AS terms FROM benchmark")
def query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(tx.query_terms(F.col("text")), " ").alias("terms"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY term")
def term_document_frequency(spark, d):
    return lexical.term_stats(docs(spark, d))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY ALL")
def postings_tf(spark, d):
    return lexical.postings(docs(spark, d)).select("doc_id", "term", "tf")


@query("SELECT page_id, regexp_matches(substr(html, 1, 5000), 'Ã[\\x{80}-\\x{BF}¡-¿]|â€|Â[^\\s\\d]') AS bad FROM pages")
def mojibake_scan(spark, d):
    return table(spark, d, "pages").select("page_id", tx.has_mojibake(F.col("html")).alias("bad"))


@query("SELECT doc_id, true AS restored FROM documents")
def mojibake_fix(spark, d):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs(spark, d).select("doc_id", (tx.fix_mojibake(broken) == F.col("text")).alias("restored"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def date_es_to_iso(spark, d):
    names = F.array(*(F.lit(m) for m in tx.MONTHS))
    written = F.concat(
        F.lit("Bogotá, "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" de "), names[F.month("o_orderdate") - 1], F.lit(" de "),
        F.year("o_orderdate").cast("string"), F.lit(", firmado"),
    )
    return table(spark, d, "orders").select("o_orderkey", tx.spanish_date_to_iso(written).alias("iso"))


@query(
    "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_\\-]{8,}', '[clave omitida]', 'g'), "
    "'AIza[A-Za-z0-9_\\-]{8,}', '[clave omitida]', 'g'), '(?i)(authorization|x-api-key|api[_-]?key)\\s*[:=]\\s*\\S+', '[clave omitida]', 'g')) "
    "AS clean FROM documents"
)
def redact_secrets(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.redact(F.col("text"))).alias("clean"))


# --- lexical search ---------------------------------------------------------


@query(bm25_sql(ONE_Q) + "SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 24")
def bm25_topk(spark, d):
    return lexical.bm25(docs(spark, d), one_query(spark), 24).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(bm25_sql(BENCH_Q) + "SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 24")
def bm25_multi_query(spark, d):
    return lexical.bm25(docs(spark, d), bench_terms(spark, d), 24).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {DOCS_T}, {BENCH_Q}, n AS (SELECT count(*) AS n FROM d),
    s AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY term),
    r AS (SELECT query_id, term, df, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS rank
        FROM q JOIN s USING (term), n WHERE df >= 5 AND df <= 0.25 * n)
    SELECT query_id, term, df, rank FROM r WHERE rank <= 12"""
)
def df_band_terms(spark, d):
    stats = lexical.term_stats(docs(spark, d))
    n = docs(spark, d).agg(F.count("*").alias("n"))
    return lexical.df_band_terms(bench_terms(spark, d), stats, n).withColumn("rank", F.col("rank").cast("long"))


@query(
    bm25_sql(BENCH_Q)
    + """, o AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kept_rank
        FROM ranked r JOIN documents USING (doc_id) WHERE rank <= 192 AND source IN ('src1', 'src3', 'src5'))
    SELECT query_id, doc_id, score, kept_rank FROM o WHERE kept_rank <= 24"""
)
def bm25_source_oversample(spark, d):
    ranked = lexical.bm25(docs(spark, d), bench_terms(spark, d), 192, keep=["source"])
    out = lexical.oversampled(ranked, "source", ["src1", "src3", "src5"], 8)
    return out.select("query_id", "doc_id", "score", F.col("kept_rank").cast("long").alias("kept_rank"))


# --- vectors ----------------------------------------------------------------


def _knn(spark, d, metric="l2", label=None, k=24):
    v = table(spark, d, "embeddings")
    v = v.filter(F.col("label") == label) if label is not None else v
    return vector.knn(v, query_vectors(spark, d), k, metric)


@query(KNN_SQL.format(d=L2, where="") + "SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 24")
def knn_l2_topk(spark, d):
    return _knn(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query(KNN_SQL.format(d=COS, where="") + "SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 24")
def knn_cosine_topk(spark, d):
    return _knn(spark, d, "cosine").withColumn("rank", F.col("rank").cast("long"))


@query(KNN_SQL.format(d=L2, where="WHERE v.label = 3") + "SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 10")
def knn_filtered_label(spark, d):
    return _knn(spark, d, label=3, k=10).withColumn("rank", F.col("rank").cast("long"))


@query(KNN_SQL.format(d=L2, where="") + "SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 5")
def knn_native_expressions(spark, d):
    return vector.knn_native(table(spark, d, "embeddings"), query_vectors(spark, d), 5).select(
        "query_id", "vec_id", "distance", F.col("rank").cast("long").alias("rank")
    )


# --- fusion -----------------------------------------------------------------

FUSED_SQL = (
    bm25_sql(BENCH_Q)
    + """, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    x AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, """
    + L2.replace("e, qe", "a.e, b.e")
    + """ AS distance FROM v a, v b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
    vr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS vr FROM x),
    lr AS (SELECT query_id, doc_id, rank AS lr FROM ranked WHERE rank <= 24),
    u AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, vr, lr
        FROM (SELECT * FROM vr WHERE vr <= 24) a FULL JOIN lr b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)
"""
)


def both_lists(spark, d):
    lex = lexical.bm25(docs(spark, d), bench_terms(spark, d), 24)
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    qv = table(spark, d, "embeddings").join(small(bench), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    near = vector.knn(table(spark, d, "embeddings"), qv, 24).withColumnRenamed("vec_id", "doc_id")
    return near, lex


@query(
    FUSED_SQL
    + """, f AS (SELECT query_id, doc_id, vr, lr, round(coalesce(1.0 / (59 + vr), 0) + coalesce(0.8 / (59 + lr), 0), 9) AS score FROM u),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr NULLS LAST, lr NULLS LAST, doc_id) AS rank FROM f)
    SELECT query_id, g.doc_id, score, rank, source FROM g JOIN documents USING (doc_id) WHERE rank <= 8"""
)
def rrf_hybrid(spark, d):
    fused = fusion.rrf(*both_lists(spark, d), 8)
    hits = fused.join(docs(spark, d).select("doc_id", "source"), "doc_id")
    return hits.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"), "source")


@query(
    FUSED_SQL
    + """, w AS (SELECT unnest([0.0, 0.5, 0.8, 1.0, 2.0]) AS weight),
    f AS (SELECT weight::DOUBLE AS weight, query_id, doc_id, vr, lr, round(coalesce(1.0 / (59 + vr), 0) + coalesce(weight / (59 + lr), 0), 9) AS score FROM u, w),
    g AS (SELECT *, row_number() OVER (PARTITION BY weight, query_id ORDER BY score DESC, vr NULLS LAST, lr NULLS LAST, doc_id) AS rank FROM f)
    SELECT weight, query_id, doc_id, score, rank FROM g WHERE rank <= 5"""
)
def rrf_weight_sweep(spark, d):
    out = fusion.weight_sweep(*both_lists(spark, d), [0.0, 0.5, 0.8, 1.0, 2.0], 5)
    return out.select("weight", "query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    FUSED_SQL
    + """, l AS (SELECT query_id, doc_id, vr AS r FROM vr WHERE vr <= 24 UNION ALL SELECT query_id, doc_id, lr FROM lr),
    f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + r)), 9) AS score FROM l GROUP BY ALL),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
    SELECT query_id, doc_id, score, rank FROM g WHERE rank <= 8"""
)
def hyde_fusion_unweighted(spark, d):
    near, lex = both_lists(spark, d)
    lists = near.select("query_id", "doc_id", "rank").unionByName(lex.select("query_id", "doc_id", "rank"))
    return fusion.fuse_unweighted(lists, 8).withColumn("rank", F.col("rank").cast("long"))


@query(
    bm25_sql(BENCH_Q)
    + """, b AS (SELECT r.*, source FROM ranked r JOIN documents USING (doc_id) WHERE rank <= 100),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS own FROM b),
    z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS doc_rank FROM o WHERE own = 1)
    SELECT query_id, source, doc_id, doc_rank FROM z WHERE doc_rank <= 10"""
)
def doc_dedupe_topn(spark, d):
    ranked = lexical.bm25(docs(spark, d), bench_terms(spark, d), 100, keep=["source"])
    out = fusion.first_of_document(ranked, "source", 10)
    return out.select("query_id", "source", "doc_id", F.col("doc_rank").cast("long").alias("doc_rank"))


@query(
    "SELECT conv_id, turn FROM conversations WHERE NOT (length(text) < 200 AND (contains(upper(text), 'COMUNÍQUESE') OR contains(upper(text), 'CÚMPLASE') "
    "OR contains(upper(text), 'DADO EN') OR contains(upper(text), 'FIRMA') OR contains(upper(text), 'MINISTRO') OR contains(upper(text), 'PRESIDENTE') "
    "OR contains(upper(text), 'CONGRESO')))"
)
def ceremonial_filter(spark, d):
    return fusion.drop_ceremonial(table(spark, d, "conversations")).select("conv_id", "turn")


@query(
    bm25_sql(BENCH_Q)
    + """, r AS (SELECT *, (hash_score % 1000)::BIGINT AS s FROM (SELECT *, (doc_id * 7919 + query_id * 104729) AS hash_score FROM ranked WHERE rank <= 50)),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (rank > 40), CASE WHEN rank <= 40 THEN -s END, rank) AS new_rank FROM r)
    SELECT query_id, doc_id, rank, new_rank FROM n"""
)
def rerank_window(spark, d):
    ranked = lexical.bm25(docs(spark, d), bench_terms(spark, d), 50)
    scored = ranked.withColumn("s", F.pmod(F.col("doc_id") * 7919 + F.col("query_id") * 104729, F.lit(1000)))
    out = fusion.rerank(scored, "s")
    return out.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.col("new_rank").cast("long").alias("new_rank"))


# --- chunking ---------------------------------------------------------------


@query(
    """WITH s AS (SELECT doc_id, text, length(text) AS n FROM documents),
    w AS (SELECT doc_id, text, n, unnest(CASE WHEN n <= 1500 THEN [0] ELSE range(0, ceil((n - 200) / 1300.0)::BIGINT) END) AS ord FROM s)
    SELECT doc_id, ord::BIGINT AS ord, md5(CASE WHEN n <= 1500 THEN text ELSE substr(text, (ord * 1300 + 1)::BIGINT, 1500) END) AS piece FROM w"""
)
def chunk_size_windows(spark, d):
    out = docs(spark, d).select("doc_id", F.posexplode(chunking.size_windows(F.col("text"))).alias("ord", "p"))
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5("p").alias("piece"))


@query()
def chunk_paragraph_pack(spark, d):
    joined = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text")
    )
    out = chunking.fragments(joined.select(F.col("conv_id").alias("id"), "text"))
    return out.select("fragment_id", "document_id", "ord", F.length("text").alias("n_chars"))


# --- corpus -----------------------------------------------------------------


@query(
    """WITH b AS (SELECT source, length(text) AS len, text, regexp_matches(substr(text, 1, 5000), 'Ã[\\x{80}-\\x{BF}¡-¿]|â€|Â[^\\s\\d]') AS bad FROM documents),
    o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY len) AS rn, count(*) OVER (PARTITION BY source) AS total FROM b)
    SELECT source, count(*) AS n_docs, count(*) FILTER (len = 0) AS n_empty, count(*) FILTER (len < 100) AS n_short, min(len)::BIGINT AS min_len,
    max(len)::BIGINT AS max_len, floor(sum(len) / count(*))::BIGINT AS mean_len, count(*) FILTER (bad) AS n_mojibake,
    floor(100 * count(*) FILTER (bad) / count(*))::BIGINT AS pct_mojibake,
    max(len) FILTER (rn = total // 2 + 1)::BIGINT AS median_len, count(DISTINCT text) AS n_texts FROM o GROUP BY source"""
)
def audit_profile(spark, d):
    out = corpus.audit_profile(docs(spark, d))
    return out.withColumns({c: F.col(c).cast("long") for c in ("min_len", "max_len", "n_docs")})


@query("SELECT o_custkey AS key, count(*) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return corpus.repeated(table(spark, d, "orders"), F.col("o_custkey"), "o_orderkey")


@query("SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates_by_hash(spark, d):
    return corpus.repeated(docs(spark, d), F.md5("text"), "doc_id")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def source_catalogue(spark, d):
    return corpus.source_catalogue(docs(spark, d), F.col("source"))


@query(
    """SELECT substr(sha256(string_agg(i || n, '' ORDER BY i, n)), 1, 16) AS fingerprint, count(*) AS n_docs
    FROM (SELECT doc_id::VARCHAR AS i, length(text)::VARCHAR AS n FROM documents)"""
)
def corpus_fingerprint(spark, d):
    return corpus.fingerprint(docs(spark, d))


@query()
def corpus_fingerprint_tree(spark, d):
    return corpus.fingerprint_tree(docs(spark, d))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return corpus.pending(docs(spark, d), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT DISTINCT vec_id AS doc_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def superset_violations(spark, d):
    indexed = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"))
    return corpus.superset_violations(indexed, table(spark, d, "labels"), "doc_id")


@query(
    "SELECT o_custkey FROM (SELECT unnest(range(1, (SELECT max(c_custkey) + 1 FROM customer))) AS o_custkey) WHERE o_custkey NOT IN (SELECT o_custkey FROM orders)"
)
def missing_numbers(spark, d):
    most = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0]
    return corpus.missing_numbers(table(spark, d, "orders"), "o_custkey", 1, most)


@query("SELECT doc_id AS src, doc_id * 2 AS dst FROM documents WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)")
def broken_references(spark, d):
    edges = docs(spark, d).select(F.col("doc_id").alias("src"), (F.col("doc_id") * 2).alias("dst"))
    return corpus.broken_references(edges, docs(spark, d).select(F.col("doc_id").alias("id"))).select("src", "dst")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 7 + n_regionkey) % 25 AS dst FROM nation),
    r(seed, node, level) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT seed, dst, level + 1 FROM r JOIN e ON node = src WHERE level < 3)
    SELECT seed, node, min(level)::BIGINT AS level FROM r GROUP BY seed, node"""
)
def graph_closure_depth3(spark, d):
    n = table(spark, d, "nation")
    edges = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 25).alias("dst"))
    return corpus.closure(edges, n.select(F.col("n_nationkey").alias("id")), 3).withColumn("level", F.col("level").cast("long"))


@query(
    """SELECT event_id, max(value) FILTER (key = 'k1') AS k1, max(value) FILTER (key = 'k2') AS k2 FROM (
    SELECT event_id, 'k1' AS key, event_type AS value FROM events UNION ALL SELECT event_id, 'k2', user_id::VARCHAR FROM events) GROUP BY event_id"""
)
def eav_pivot(spark, d):
    e = table(spark, d, "events")
    pairs = F.explode(F.array(F.struct(F.lit("k1").alias("k"), F.col("event_type").alias("v")), F.struct(F.lit("k2").alias("k"), F.col("user_id").cast("string").alias("v"))))
    rows = e.select("event_id", pairs.alias("x")).select("event_id", "x.k", "x.v")
    return corpus.eav_pivot(rows, "event_id", "k", "v", ["k1", "k2"])


# --- validity and grounding -------------------------------------------------

# Notes are put into the texts of documents, at their start or their end, so that the readers and the SQL parse whole texts.
NOTE_TEXTS = (
    "<Artículo derogado por el artículo 5 de la Ley 10 de 1990>",
    "<Decreto 150 de 1997 derogado por el Decreto 9 de 2001>",
    "<Ley INEXEQUIBLE> y <Numeral 3 suspendido>",
    "<NOTA DE VIGENCIA: Resolución revocada por el Oficio 33>",
    "NOTA DE VIGENCIA: Concepto 7 de 2005 declarado nulo por la Sentencia 4",
    "sin nota alguna, <Editorial: texto>",
    "<Derogado> <Circular   nula>",
)
NOTE_TEXTS_SQL = "[" + ", ".join("'" + t + "'" for t in NOTE_TEXTS) + "]"
_DOC_SQL = r"(?:Decreto|Ley|Resoluci[oó]n|Oficio|Concepto|Circular|Acuerdo|Orden|Norma)"
_PART_SQL = r"(?:Art[ií]culo|Par[aá]grafo|Inciso|Numeral|Literal|Aparte(?: tachado)?|Cap[ií]tulo|T[ií]tulo|Ordinal)"
_VERB_SQL = r"((?i:(?:declarad[oa]s? )?inexequibles?|derogad[oa]s?|revocad[oa]s?|suspendid[oa]s?|declarad[oa]s? nul[oa]s?|nul[oa]s?))"
NOTES_SQL = rf"""f AS (SELECT doc_id, 'dian:circular_' || (doc_id // 3) || '_2005' AS document_id, doc_id % 3 AS ord, CASE WHEN doc_id % 2 = 0
        THEN ({NOTE_TEXTS_SQL})[(doc_id % 7)::INT + 1] || ' ' || text ELSE text || chr(10) || ({NOTE_TEXTS_SQL})[(doc_id % 7)::INT + 1] END AS texto FROM documents),
    raw AS (SELECT doc_id, document_id, ord, regexp_extract_all(texto, '<\s*(?:NOTA DE VIGENCIA:\s*)?[^<>]{{0,200}}?>|NOTA DE VIGENCIA:\s*[^\n<>]{{0,200}}') AS ms FROM f),
    u AS (SELECT doc_id, document_id, ord, unnest(ms) AS m, unnest(range(len(ms))) AS pos FROM raw),
    body AS (SELECT doc_id, document_id, ord, pos, trim(regexp_replace(regexp_replace(m, '^<\s*(?:NOTA DE VIGENCIA:\s*)?|^NOTA DE VIGENCIA:\s*|>$', '', 'g'), '\s+', ' ', 'g')) AS b FROM u),
    v AS (SELECT *, regexp_extract(b, '^\s*{_PART_SQL}\b[^<>]{{0,40}}?{_VERB_SQL}', 1) AS part, regexp_extract(b, '^\s*{_DOC_SQL}\b(?:\s+[\d.]+\s+de\s+\d{{4}})?\s+{_VERB_SQL}', 1) AS whole,
        regexp_extract(b, '^\s*{_VERB_SQL}\b', 1) AS bare FROM body),
    s AS (SELECT *, lower(CASE WHEN part <> '' THEN part WHEN whole <> '' THEN whole ELSE bare END) AS verb, CASE WHEN part <> '' THEN 'parcial' WHEN whole <> '' THEN 'documento'
        WHEN bare <> '' THEN 'parcial' END AS alcance, regexp_extract(b, '^\S+\s+(\d[\d.]*)\s+de\s+(\d{{4}})', 1) AS number, regexp_extract(b, '^\S+\s+(\d[\d.]*)\s+de\s+(\d{{4}})', 2) AS year FROM v),
    n AS (SELECT doc_id, document_id, ord, pos, b AS texto, alcance, CASE WHEN alcance = 'documento' AND year <> '' AND NOT (contains(document_id, year) AND
        list_contains(regexp_extract_all(document_id, '\d+'), ltrim(replace(number, '.', ''), '0'))) THEN 'incierta' WHEN contains(verb, 'inexequible') THEN 'inexequible'
        WHEN contains(verb, 'derogad') THEN 'derogada' WHEN contains(verb, 'revocad') THEN 'revocada' WHEN contains(verb, 'suspendid') THEN 'suspendida' ELSE 'nula' END AS estado
        FROM s WHERE alcance IS NOT NULL AND b <> ''),
    z AS (SELECT *, CASE estado WHEN 'inexequible' THEN 0 WHEN 'derogada' THEN 1 WHEN 'nula' THEN 2 WHEN 'revocada' THEN 3 WHEN 'suspendida' THEN 4 ELSE 5 END AS sev FROM n),
    t AS (SELECT document_id, min(row(sev, ord, pos, estado, texto)) AS m FROM z WHERE alcance = 'documento' GROUP BY document_id)"""


def note_fragments(spark, d):
    i, which = F.col("doc_id"), F.array(*map(F.lit, NOTE_TEXTS))[F.pmod("doc_id", F.lit(7)).cast("int")]
    return docs(spark, d).select(
        F.concat(F.lit("dian:circular_"), (i / 3).cast("long").cast("string"), F.lit("_2005::frag"), (i % 3).cast("string")).alias("id"),
        F.when(i % 2 == 0, F.concat(which, F.lit(" "), "text")).otherwise(F.concat("text", F.lit("\n"), which)).alias("texto"), "doc_id",
    )


@query(f"WITH {NOTES_SQL} SELECT doc_id, pos, texto, estado, alcance FROM n")
def validity_notes(spark, d):
    f = note_fragments(spark, d).select("id", "doc_id", F.posexplode(validity.all_notes(F.col("texto"))).alias("pos", "n")).filter("n.alcance is not null and n.texto <> ''")
    n = validity.attributed(F.col("n"), tx.document_of(F.col("id")))
    return f.select("doc_id", F.col("pos").cast("long").alias("pos"), n["texto"].alias("texto"), n["estado"].alias("estado"), n["alcance"].alias("alcance"))


@query(f"WITH {NOTES_SQL} SELECT document_id, m[4] AS estado, 'documento' AS alcance, m[5] AS texto FROM t")
def validity_table(spark, d):
    return validity.validity_table(note_fragments(spark, d)).select("document_id", "estado", "alcance", "texto")


@query(
    f"""WITH {NOTES_SQL}, p AS (SELECT doc_id, min(row(sev, pos, estado)) AS m FROM z WHERE alcance = 'parcial' GROUP BY doc_id)
    SELECT f.doc_id, CASE WHEN t.m[1] < 5 THEN t.m[4] WHEN p.m IS NOT NULL THEN p.m[3] WHEN t.m IS NOT NULL THEN 'incierta' ELSE 'sin_nota' END AS estado
    FROM f LEFT JOIN t USING (document_id) LEFT JOIN p ON p.doc_id = f.doc_id"""
)
def validity_annotate(spark, d):
    f = note_fragments(spark, d)
    return validity.annotate(f, validity.validity_table(f)).select("doc_id", F.col("vigencia.estado").alias("estado"))


@query(
    FUSED_SQL
    + """, f AS (SELECT query_id, doc_id, vr, lr, round(coalesce(1.0 / (59 + vr), 0) + coalesce(0.8 / (59 + lr), 0), 9) AS score FROM u),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr NULLS LAST, lr NULLS LAST, doc_id) AS rank FROM f),
    off AS (SELECT *, query_id % 5 = 0 OR doc_id % 6 IN (2, 3) AS gone FROM g),
    b AS (SELECT query_id, max(score) FILTER (rank = 1) AS s1, coalesce(max(score) FILTER (rank = 2), 0) AS s2, bool_and(gone) FILTER (rank <= 5) AS gone,
        string_agg('Doc ' || doc_id, ', ' ORDER BY rank) FILTER (rank <= 5) AS names FROM off GROUP BY query_id),
    k AS (SELECT unnest([true, false]) AS external_key),
    w AS (SELECT item_id AS query_id, external_key, names, CASE WHEN s1 IS NULL THEN 'none' WHEN gone THEN 'gone' WHEN s1 < 0.020 THEN 'weak'
        WHEN s1 >= 0.045 AND (s2 = 0 OR s1 / s2 >= 1.15) THEN 'clear' WHEN external_key THEN 'external' ELSE 'local' END AS w
        FROM benchmark LEFT JOIN b ON item_id = query_id, k)
    SELECT query_id, external_key, CASE w WHEN 'none' THEN 'abstenerse' WHEN 'gone' THEN 'abstenerse' WHEN 'weak' THEN 'condicional' WHEN 'external' THEN 'externo' ELSE 'local' END AS motor,
        CASE w WHEN 'none' THEN 'La búsqueda no encontró nada en el índice.'
        WHEN 'gone' THEN 'Lo único que el índice tiene sobre esto son normas que ya no rigen según su propia nota oficial: ' || names || '. Busca la norma que las reemplazó.'
        WHEN 'weak' THEN 'Coincidencia débil: solo un método de búsqueda encontró estos documentos.' WHEN 'clear' THEN 'Un documento destaca con claridad: el modelo propio basta.'
        WHEN 'external' THEN 'Varios documentos compiten y hay que discriminar entre ellos.'
        ELSE 'Consulta difícil y sin clave de IA externa configurada: responde el modelo propio, con menos confianza.' END AS motivo FROM w"""
)
def route_decision(spark, d):
    fused = fusion.rrf(*both_lists(spark, d), None)
    i = F.col("doc_id")
    off = (F.col("query_id") % 5 == 0) | F.pmod(i, F.lit(6)).isin(2, 3)
    hits = staged(fused.select("query_id", "rank", "score", off.alias("not_valid"), F.concat(F.lit("Doc "), i.cast("string")).alias("titulo")), "hits")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    both = [routing.decide(asked, hits, k).withColumn("external_key", F.lit(k)) for k in (True, False)]
    return both[0].unionByName(both[1]).select("query_id", "external_key", "motor", "motivo")


# Claims are put behind the turns of conversations, so that the readers and the SQL look for them in whole texts.
CLAIM_TEXTS = (
    " Según la Ley 100 de 1993 y el decreto NÚMERO 2591 del 1991, el plazo es de 15 días.",
    " El artículo 13.2 y el art. 7. exigen 30 SMMLV; la sentencia T-760/08 lo confirma.",
    " El interés es del 2,5 % o del 19 por ciento; resolución 8 de 2010, circular EXTERNA 4 de 2019.",
    " Nada que comprobar aquí, 12 casas.",
    " Ley 100 de 1993, otra vez la ley 100 de 93 y los artículos 5, artículo 5.",
)
CLAIM_TEXTS_SQL = "[" + ", ".join("'" + t + "'" for t in CLAIM_TEXTS) + "]"
NORMS_SQL = "ley(?:es)?|decreto(?:s)?|resoluci[oó]n(?:es)?|circular(?:es)?|acuerdo(?:s)?|ordenanza(?:s)?|sentencia(?:s)?|auto(?:s)?|concepto(?:s)?|oficio(?:s)?"
FAMILIES_SQL = {
    "norma": rf"(?i)\b(?:{NORMS_SQL})\b(?:\s+[A-ZÁÉÍÓÚÑ]{{2,}})?\s*(?:n[uú]mero\s*|n[°º.]\s*)?(\d{{1,5}})\s*(?:de|del)\s*(\d{{4}})",
    "articulo": r"(?i)\bart[íi]culos?\b\.?\s*(\d+(?:\.\d+)*)|\bart\.\s*(\d+(?:\.\d+)*)",
    "sentencia": r"(?i)\b([CTSU]{1,2}-\d{1,4})\s*[/ ]\s*(?:de\s*)?(\d{2,4})",
    "cantidad": r"(?i)\b(\d{1,6})\s*(d[íi]as?|meses?|a[nñ]os?|horas?|smmlv|uvt|salarios?)\b",
    "porcentaje": r"\b(\d{1,3}(?:[.,]\d{1,2})?)\s*(?:%|por ciento)",
}


def claims_sql(rows: str) -> str:
    """CTEs up to claims(id, tipo, clave) from a relation r(id, body)."""
    parts = []
    for kind, p in FAMILIES_SQL.items():
        g = [f"regexp_extract_all(body, '{p}', {k})" for k in (1, 2)]
        key = {
            "norma": "z[1] || '|' || right(z[2], 2)", "sentencia": "z[1] || '|' || right(z[2], 2)", "articulo": "CASE WHEN length(z[1]) > 0 THEN z[1] ELSE z[2] END"
        }.get(kind, "z[1]")
        second = g[1] if kind in ("norma", "sentencia", "articulo") else g[0]
        parts.append(f"SELECT id, '{kind}' AS tipo, {key} AS clave FROM (SELECT id, unnest(list_zip({g[0]}, {second})) AS z FROM r)")
    return f"r AS ({rows}), claims AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + "))"


TURNS_WITH_CLAIMS = f"SELECT row(conv_id, turn) AS id, coalesce(text, '') || ({CLAIM_TEXTS_SQL})[((conv_id + turn) % 5)::INT + 1] AS body FROM conversations"


def with_claims(spark, d):
    said = F.array(*map(F.lit, CLAIM_TEXTS))[((F.col("conv_id") + F.col("turn")) % 5).cast("int")]
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), said).alias("body"))


@query(f"WITH {claims_sql(TURNS_WITH_CLAIMS)} SELECT id[1] AS conv_id, id[2] AS turn, tipo, clave FROM claims")
def claims_extract(spark, d):
    c = with_claims(spark, d).select("conv_id", "turn", F.explode(grounding.claims(F.col("body"))).alias("c"))
    return c.select("conv_id", "turn", F.col("c.tipo").alias("tipo"), F.col("c.clave").alias("clave"))


CONTEXT = "LEY 100 DEL AÑO 1993; el numeral 13.2 y 15 dias. T-760, de 2008: un 19 y 2591 (1991)"


@query(
    rf"""WITH {claims_sql(TURNS_WITH_CLAIMS)},
    k AS (SELECT *, CASE WHEN id[1] % 2 = 0 THEN strip_accents(lower('{CONTEXT} x y')) ELSE 'nada x y' END AS ctx FROM claims)
    SELECT id[1] AS conv_id, id[2] AS turn, tipo, clave, CASE WHEN tipo IN ('norma', 'sentencia')
        THEN regexp_matches(ctx, split_part(clave, '|', 1) || '\D{{0,20}}(?:19|20)?' || split_part(clave, '|', 2) || '\b') ELSE contains(ctx, clave) END AS respaldada FROM k"""
)
def claims_grounded(spark, d):
    text = F.when(F.col("conv_id") % 2 == 0, CONTEXT).otherwise("nada")
    frag = F.array(F.struct(F.lit("x").alias("identificador"), F.lit("y").alias("titulo"), text.alias("texto")))
    c = with_claims(spark, d).select("conv_id", "turn", F.explode(grounding.verified(F.col("body"), frag)).alias("c"))
    return c.select("conv_id", "turn", "c.tipo", "c.clave", "c.respaldada")


@query(
    """SELECT doc_id, CASE WHEN length(q) < 15 THEN 0 ELSE 1 END AS total, CASE WHEN length(q) < 15 OR doc_id % 2 = 1 THEN 0 ELSE 1 END AS buenas
    FROM (SELECT doc_id, regexp_replace(substr(text, 1, 60), '[«»\n\\s]+', ' ', 'g') AS q FROM documents WHERE length(text) >= 80)"""
)
def literal_quotes(spark, d):
    q = F.regexp_replace(F.substring("text", 1, 60), "[«»\\n\\s]+", " ")
    answer = F.concat(F.lit("Dice «"), q, F.lit("» y nada más."))
    text = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.lit("otra cosa"))
    r = docs(spark, d).filter(F.length("text") >= 80).select("doc_id", grounding.literal_quotes(answer, F.array(text)).alias("r"))
    return r.select("doc_id", F.col("r.total").alias("total"), F.col("r.buenas").alias("buenas"))


# --- usage ------------------------------------------------------------------

LOCAL_DAY = "strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d')"


@query(
    f"""WITH n AS (SELECT event_id, user_id, {LOCAL_DAY} AS period, row_number() OVER (PARTITION BY user_id, {LOCAL_DAY} ORDER BY ts, event_id) AS rn FROM events)
    SELECT event_id, user_id, period, least(rn, 3) AS used, rn <= 3 AS allowed, rn <= 3 AND rn > 2 AS suggest FROM n"""
)
def quota_daily_verdict(spark, d):
    out = usage.daily_verdicts(table(spark, d, "events"), soft=2, hard=3)
    return out.select("event_id", "user_id", "period", F.col("used").cast("long").alias("used"), "allowed", "suggest")


@query(
    """WITH e AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 20 END AS tope,
        CASE WHEN user_id % 2 = 0 THEN strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') ELSE strftime(ts - INTERVAL 5 HOUR, '%Y-%m') END AS period FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, period ORDER BY ts, event_id) AS rn FROM e)
    SELECT event_id, period, CASE WHEN tope IS NULL THEN rn ELSE least(rn, tope) END::BIGINT AS used, tope IS NULL OR rn <= tope AS allowed FROM n"""
)
def quota_monthly_plan(spark, d):
    e = table(spark, d, "events")
    plans = e.select("user_id").distinct().select(
        "user_id",
        F.when(F.col("user_id") % 3 == 0, 5).when(F.col("user_id") % 3 == 1, 20).cast("long").alias("tope"),
        F.when(F.col("user_id") % 2 == 0, "dia").otherwise("mes").alias("periodo"),
        F.lit(None).cast("date").alias("vence"),
    )
    return usage.plan_verdicts(e, plans, "user_id", "ts", "event_id").select("event_id", "period", "used", "allowed")


@query(
    """SELECT strftime(ts - INTERVAL 5 HOUR, '%Y-%m') AS month, round(sum(greatest(value, 0)), 6) AS usd, round(sum(greatest(value, 0)), 6) >= 10 AS over
    FROM events GROUP BY 1"""
)
def budget_monthly(spark, d):
    return usage.monthly_spend(table(spark, d, "events"), "value", "ts")


@query(
    """WITH p(model, i, o) AS (VALUES ('claude-haiku-4-5', 1.00, 5.00), ('gpt-4o', 2.50, 10.00), ('llama3.1', 0.0, 0.0)),
    c AS (SELECT conv_id, turn, text, CASE conv_id % 4 WHEN 0 THEN 'claude-haiku-4-5' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'llama3.1' ELSE 'unknown' END AS model FROM conversations),
    e AS (SELECT conv_id, turn, c.model, i, o, CASE WHEN i IS NULL THEN 0 ELSE floor(length(text) * 0.28::DOUBLE)::BIGINT END AS tokens_in FROM c LEFT JOIN p USING (model))
    SELECT conv_id, turn, model, tokens_in, round(coalesce(tokens_in / 1e6 * i + 400 / 1e6 * o, 0)::DOUBLE, 9) AS usd FROM e"""
)
def cost_estimate(spark, d):
    model = F.array(*map(F.lit, ("claude-haiku-4-5", "gpt-4o", "llama3.1", "unknown")))[(F.col("conv_id") % 4).cast("int")]
    c = table(spark, d, "conversations").withColumn("model", model)
    return usage.estimated(c, "text", "model").select("conv_id", "turn", "model", "tokens_in", F.round("usd", 9).alias("usd"))


# --- evaluation -------------------------------------------------------------

GOLD_SQL = (
    bm25_sql(BENCH_Q)
    + """, g AS (SELECT item_id AS query_id, (item_id * 37) % 200 AS gold_id, 'src' || (item_id % 20) AS gold_document, 'p' || (item_id % 3) AS perfil FROM benchmark),
    m AS (SELECT g.query_id, min(rank) AS hit_rank FROM g JOIN ranked r USING (query_id) JOIN documents d2 ON d2.doc_id = r.doc_id
        WHERE rank <= 10 AND (r.doc_id = gold_id OR d2.source = gold_document) GROUP BY g.query_id),
    gh AS (SELECT g.*, hit_rank FROM g LEFT JOIN m USING (query_id))
"""
)
METRICS_SQL = """count(*) AS n, round(avg(coalesce((hit_rank <= 1)::INT, 0)), 6) AS recall_1, round(avg(coalesce((hit_rank <= 5)::INT, 0)), 6) AS recall_5,
    round(avg(coalesce((hit_rank <= 10)::INT, 0)), 6) AS recall_10, round(avg(coalesce(CASE WHEN hit_rank <= 10 THEN 1.0 / hit_rank END, 0)), 6) AS mrr_10"""


def gold_hits(spark, d):
    item = F.col("item_id")
    gold = table(spark, d, "benchmark").select(
        item.alias("query_id"), (item * 37 % 200).alias("gold_id"), F.concat(F.lit("src"), (item % 20).cast("string")).alias("gold_document"),
        F.concat(F.lit("p"), (item % 3).cast("string")).alias("perfil"),
    )
    ranked = lexical.bm25(docs(spark, d), bench_terms(spark, d), 10, keep=["source"]).withColumnRenamed("source", "document")
    return gold, ranked


@query(GOLD_SQL + f"SELECT {METRICS_SQL} FROM gh")
def recall_mrr(spark, d):
    return evaluate.recall(evaluate.first_hits(*gold_hits(spark, d), 10), [1, 5, 10], 10, [])


@query(GOLD_SQL + f"SELECT perfil, gold_document, {METRICS_SQL} FROM gh GROUP BY GROUPING SETS ((), (perfil), (gold_document))")
def recall_grouping_sets(spark, d):
    return evaluate.recall(evaluate.first_hits(*gold_hits(spark, d), 10), [1, 5, 10], 10, ["perfil", "gold_document"])


@query(
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS n10, count(*) FILTER (quality = 0 AND toxic = 1) AS n01 FROM labels),
    r AS (SELECT n10, n01, n10 + n01 AS n, least(n10, n01) AS k FROM c),
    p AS (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS s FROM r, range(0, 100000) t(i) WHERE i <= k)
    SELECT n10, n01, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * s) END, 6) AS p FROM r, p"""
)
def mcnemar_exact(spark, d):
    pairs = table(spark, d, "labels")
    return evaluate.mcnemar(pairs.select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")))


@query(
    """WITH c AS (SELECT doc_id % 40 AS k, sum(quality) AS s, count(*) AS n FROM labels GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS m FROM c),
    d AS (SELECT rep, draw, ('0x' || substr(md5(rep || '|' || draw), 1, 8))::BIGINT % m AS pos
        FROM range(0, 2000) a(rep), range(0, 1000) b(draw), (SELECT max(m) AS m FROM o) WHERE draw < m),
    e AS (SELECT rep, sum(s) / sum(n) AS mean FROM d JOIN o USING (pos) GROUP BY rep),
    f AS (SELECT list(mean ORDER BY mean) AS v FROM e)
    SELECT round(v[51], 6) AS low, round(v[1950], 6) AS high FROM f"""
)
def bootstrap_ci(spark, d):
    rows = table(spark, d, "labels").withColumn("k", F.col("doc_id") % 40)
    return evaluate.cluster_bootstrap(rows, "k", "quality")


@query(
    """WITH s AS (SELECT (doc_id * 7919 % 1000) / 1000.0 AS s, quality AS c FROM labels), t AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS threshold)
    SELECT threshold::DOUBLE AS threshold, round(count(*) / (SELECT count(*) FROM labels), 6) AS coverage, round(sum(c) / count(*), 6) AS precision
    FROM s, t WHERE s::DOUBLE >= threshold::DOUBLE GROUP BY 1"""
)
def abstention_curve(spark, d):
    rows = table(spark, d, "labels").withColumn("s", F.col("doc_id") * 7919 % 1000 / 1000.0)
    return evaluate.abstention_curve(rows, "s", "quality", [0.1, 0.25, 0.5, 0.75, 0.9])


@query(
    """WITH o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s|' || doc_id), doc_id) AS pick FROM documents)
    SELECT doc_id, lang, pick FROM o WHERE pick <= CASE lang WHEN 'en' THEN 40 WHEN 'es' THEN 20 ELSE 10 END"""
)
def stratified_sample(spark, d):
    out = evaluate.stratified_sample(docs(spark, d), "lang", "doc_id", {"en": 40, "es": 20, "fr": 10, "de": 10}, "s")
    return out.select("doc_id", "lang", F.col("pick").cast("long").alias("pick"))


@query(
    """SELECT conv_id, turn, CASE WHEN ('0x' || substr(md5('20260906|' || conv_id), 1, 8))::BIGINT / 4294967296.0 < 0.4 THEN 'test' ELSE 'dev' END AS part
    FROM conversations"""
)
def split_by_document(spark, d):
    return evaluate.split_by_document(table(spark, d, "conversations"), "conv_id", 0.4, "20260906").select("conv_id", "turn", "part")



def content(col: str) -> str:
    return f"list_distinct(list_filter({toks(col)}, lambda t: length(t) > 3 AND NOT list_contains({STOP}, t)))"



@query(
    f"""WITH u AS (SELECT conv_id, turn, text, role, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT {content('text')} AS q, {content('answer')} AS a FROM u WHERE role = 'user' AND next_role = 'assistant'),
    b AS (SELECT unnest({content('text')}) AS legal FROM conversations),
    f AS (SELECT legal, count(*) AS df FROM b GROUP BY 1 HAVING count(*) >= 4), n AS (SELECT count(*) AS n_docs FROM conversations),
    t AS (SELECT unnest(q) AS term FROM p), v AS (SELECT term, count(*) AS times FROM t GROUP BY 1 HAVING count(*) >= 4),
    j AS (SELECT term, legal, count(*) AS n FROM (SELECT term, unnest(l) AS legal FROM (SELECT unnest(q) AS term, list_filter(a, lambda x: NOT list_contains(q, x)) AS l FROM p)) GROUP BY ALL HAVING count(*) >= 4),
    s AS (SELECT term, legal, ln((n / times) / (df / n_docs)) AS pmi, n FROM j JOIN v USING (term) JOIN f USING (legal), n),
    r AS (SELECT term, legal, round(pmi * ln(1 + s.n), 6) AS score FROM s WHERE pmi > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, legal DESC) AS rank FROM r)
    SELECT term, legal, score, rank FROM k WHERE rank <= 4"""
)
def pmi_lexicon(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumn("positive", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    pairs = pairs.filter("role = 'user' AND next_role = 'assistant'").select(F.col("text").alias("query"), "positive")
    return evaluate.pmi_lexicon(pairs, c.select("text")).withColumn("rank", F.col("rank").cast("long"))


@query(
    GOLD_SQL
    + """, x AS (SELECT query_id, r.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pick FROM g JOIN ranked r USING (query_id)
        JOIN documents d2 ON d2.doc_id = r.doc_id WHERE rank <= 10 AND r.doc_id <> gold_id AND d2.source <> gold_document)
    SELECT query_id, doc_id, pick FROM x WHERE pick <= 3"""
)
def hard_negatives(spark, d):
    gold, ranked = gold_hits(spark, d)
    return evaluate.hard_negatives(gold, ranked.select("query_id", "doc_id", "document", "rank"), 3).withColumn("pick", F.col("pick").cast("long"))


@query("WITH o AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p, count(*) OVER () AS n FROM benchmark) SELECT a.item_id AS id, b.item_id AS other FROM o a JOIN o b ON b.p = (a.p + 3) % a.n")
def circular_pairs(spark, d):
    return evaluate.circular_pairs(table(spark, d, "benchmark"), "item_id")


# --- sources and streams ----------------------------------------------------


@query()
def html_documents(spark, d):
    out = connectors.html_documents(table(spark, d, "pages"))
    return out.select("id", "titulo", F.length("texto").alias("n_chars"), F.size("enlaces").alias("n_links"))


@query(
    f"""WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, {LOCAL_DAY} ORDER BY ts, event_id) AS rn FROM events)
    SELECT event_id, user_id, least(rn, 3) AS used, rn <= 3 AS allowed, rn <= 3 AND rn > 2 AS suggest FROM n"""
)
def streaming_quota_equals_batch(spark, d):
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern: the table may be a file or a folder
    return quota.run_once(quota.verdicts(stream, hard=3, soft=2), spark, f"{base}/out", f"{base}/checkpoint").drop("period")
