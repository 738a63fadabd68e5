"""Text kernel, lexical and vector search, fusion."""

from __future__ import annotations

import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvina.functions import text as tx
from corvina.operators import fusion, lexical, vector
from corvina.plans.search import search


def fold(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "asked",
    ["Buenas tardes, ¿me pueden ayudar con la pensión de mi mamá?", "el la los", "acción Acción ACCION niño_1 año", "", "a " * 5 + " ".join(f"palabra{i}" for i in range(20))],
)
def test_query_terms(spark, asked):
    raw = re.findall(r"\w+", fold(asked))
    useful = []
    for t in raw:
        if len(t) > 2 and t not in tx.STOP_WORDS and t not in useful:
            useful.append(t)
    assert one(spark, tx.query_terms(F.col("t")), t=asked) == (useful[:12] or raw[:12])


def test_stop_words():
    assert len(set(tx.STOP_WORDS)) == 138


@pytest.mark.parametrize(
    ("given", "want"),
    [("producciÃ³n", "producción"), ("producciÃ³n de cafÃ© ñ €", "producción de café ñ €"), ("normal", "normal"), ("", ""), ("ya está bien", "ya está bien")],
)
def test_fix_mojibake(spark, given, want):
    assert one(spark, tx.fix_mojibake(F.col("t")), t=given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("26 de mayo de 2015", "2015-05-26"), ("Bogotá, 3 de ENERO de 1999 y 4 de junio de 2000", "1999-01-03"), ("sin fecha", "sin fecha")],
)
def test_spanish_dates(spark, given, want):
    assert one(spark, tx.spanish_date_to_iso(F.col("t")), t=given) == want


def test_redaction_and_ids(spark):
    assert one(spark, tx.redact(F.col("t")), t="usa sk-abcdefghijk y Authorization: Bearer") == "usa [clave omitida] y [clave omitida]"
    assert one(spark, tx.document_of(F.col("t")), t="a:ahorros:::frag0") == "a:ahorros:"
    assert one(spark, tx.document_of(F.col("t")), t="sin") == "sin"
    assert one(spark, tx.fts_expression(F.split("t", " ")), t="a b") == '"a" OR "b"'


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "el perro ladra perro", "a"), (2, "gato y perro", "b"), (3, "nada que ver aquí", "a"), (4, "gato gato gato", "b"), (5, "otra cosa", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_bm25_by_hand(spark, docs):
    terms = spark.createDataFrame([(7, "perro"), (7, "gato")], "query_id int, term string")
    got = {r["doc_id"]: r["score"] for r in lexical.bm25(docs, terms, 10).collect()}
    words = {r["doc_id"]: fold(r["text"]).split() for r in docs.collect()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    for d, w in words.items():
        score = 0.0
        for t in ("perro", "gato"):
            df = sum(t in v for v in words.values())
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
            tf = w.count(t)
            score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        assert abs(got.get(d, 0.0) - score) < 1e-6


def test_index_is_the_postings(spark, docs, tmp_path):
    lexical.write_index(docs, str(tmp_path / "i"))
    p = lexical.stored_postings(spark, str(tmp_path / "i"))
    assert {(r["term"], r["doc_id"], r["tf"]) for r in p.collect()} >= {("perro", 1, 2), ("gato", 4, 3)}


def test_knn_forms_agree(spark):
    v = spark.range(50).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k).cast("float") for k in (1, 2, 3))).alias("embedding"))
    q = v.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    a = vector.knn(v, q, 4).select("query_id", "vec_id", "rank").collect()
    b = vector.knn_native(v, q, 4).select("query_id", "vec_id", "rank").collect()
    assert sorted(a) == sorted(b) and len(a) == 20
    assert vector.knn(v, q.limit(0), 4).count() == 0


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, doc_id long, rank int")


def test_rrf_ties_and_weights(spark):
    v, le = ranked(spark, [(1, 10, 1), (1, 11, 2)]), ranked(spark, [(1, 11, 1), (1, 12, 2)])
    got = [(r["doc_id"], round(r["score"], 6)) for r in fusion.rrf(v, le, 8).orderBy("rank").collect()]
    assert got == [(11, round(1 / 61 + 0.8 / 60, 6)), (10, round(1 / 60, 6)), (12, round(0.8 / 61, 6))]
    same = fusion.rrf(ranked(spark, [(1, 5, 1)]), ranked(spark, [(1, 3, 1)]), 8, w_lexical=1.0).orderBy("rank").collect()
    assert [r["doc_id"] for r in same] == [5, 3]  # the vector list comes first in a tie
    sweep = fusion.weight_sweep(v, le, [0.0, 0.8], 1).collect()
    assert {(r["weight"], r["doc_id"]) for r in sweep} == {(0.0, 10), (0.8, 11)}


def test_ceremonial_filter_is_substring(spark):
    df = spark.createDataFrame([("se confirma",), ("x" * 250 + " firma",), ("texto útil",)], "text string")
    assert {r["text"][:5] for r in fusion.drop_ceremonial(df).collect()} == {"xxxxx", "texto"}


def test_rerank_keeps_the_tail(spark):
    df = spark.createDataFrame([(1, i, i, float(i)) for i in range(1, 6)], "query_id int, doc_id long, rank int, s double")
    got = [r["doc_id"] for r in fusion.rerank(df, "s", window=3).orderBy("new_rank").collect()]
    assert got == [3, 2, 1, 4, 5]


def test_search_end_to_end(spark, docs):
    vec = docs.select("doc_id", F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    q = spark.createDataFrame([(1, "perro", [1.0, 1.0])], "query_id int, text string, qvec array<double>")
    hits = search(docs, vec, q, k=2).orderBy("rank").collect()
    assert hits[0]["doc_id"] == 1 and len(hits) == 2
    only = search(docs, vec, q, k=3, sources=["b"]).collect()
    assert {r["source"] for r in only} == {"b"}
    again = search(docs, vec, q, k=2, scorer=lambda qs, ts: [float("gato" in t) for t in ts]).orderBy("new_rank").collect()
    assert "gato" in again[0]["texto"]


@pytest.mark.parametrize("columns, block_bytes", [(128, 64 << 20), (2, 16_000)])
def test_native_knn_takes_any_number_of_queries(spark, monkeypatch, columns, block_bytes):
    monkeypatch.setattr(vector, "COLUMNS", columns)
    part = lambda k: (F.col("id") * (7 + k) % (31 + k) / 8).cast("float")
    v = spark.range(2100).select(F.col("id").alias("vec_id"), F.array(*(part(k) for k in range(4))).alias("embedding")).repartition(3)
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    odd = spark.createDataFrame([(9000, [0.0]), (9001, None)], "vec_id long, embedding array<float>")  # another length; none
    rows = lambda x: sorted(map(tuple, x.select("query_id", "vec_id", "distance", "rank").collect()))
    got = rows(vector.knn_native(v.unionByName(odd), q, 3, block_bytes=block_bytes))
    assert got == rows(vector.knn(v, q, 3)) and len(got) == 6300  # more than 2,048 queries were refused
    empty = spark.createDataFrame([(9002, [0.0, None, 0.0, 0.0])], odd.schema)
    assert vector.knn_native(empty, q, 3).count() == 0 and vector.knn_native(v, q.limit(0), 3).count() == 0
