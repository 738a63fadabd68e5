"""Stored index, vectors under string ids, reranking, requests, quotas and banks on small tables."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.operators import banks, corpus, lexical, serving, usage, vector
from corvina.plans import search
from corvina.shared import shared_path


def test_index_gives_what_the_texts_give(spark):
    rng = random.Random(1)
    words = ["alfa", "beta", "gamma", "delta", "épsilon", "zeta"]
    rows = [(f"d{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame([*rows, ("none", None, "s1")], "doc_id string, text string, source string")
    queries = lexical.query_table(spark.createDataFrame([(1, "alfa epsilon"), (2, "zeta nada"), (3, "")], "query_id int, text string"), "query_id", "text")
    want = sorted(map(tuple, lexical.bm25(docs, queries, 7).collect()))
    parts, whole = shared_path(spark, "parts"), shared_path(spark, "whole")
    for k in range(3):
        lexical.write_index(docs.filter(F.col("source") == f"s{k}"), parts, keep=["source"])
    lexical.optimize_index(spark, parts, whole)
    for path in (parts, whole):
        assert sorted(map(tuple, lexical.bm25_index(spark, path, queries, 7).collect())) == want
    some = lexical.bm25_index(spark, whole, queries, None, ["source"], ["s1"]).collect()
    assert {r["source"] for r in some} == {"s1"}
    n, avg = 61, sum(len((r[1] or "").split()) for r in rows) / 61
    of = {r[0]: r[1].split() for r in rows}
    df = sum("zeta" in w for w in of.values())
    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    first = next(r for r in lexical.bm25(docs, queries, 1).collect() if r["query_id"] == 2)
    score = {d: idf * w.count("zeta") * 2.2 / (w.count("zeta") + 1.2 * (0.25 + 0.75 * len(w) / avg)) for d, w in of.items()}
    assert abs(first["score"] - max(score.values())) < 1e-5


@pytest.mark.parametrize("metric, block", [("l2", 2048), ("l2", 3), ("cosine", 2)])
def test_neighbours_of_any_ids(spark, metric, block):
    rng = np.random.default_rng(2)
    vectors = [(f"v{i}", rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(50)]
    rows = [*vectors, ("null", None), ("short", [1.0]), ("zero", [0.0] * 4)]
    queries = vectors[:8]
    got = vector.knn(
        spark.createDataFrame(rows, "id string, e array<double>").repartition(3),
        spark.createDataFrame(queries, "query_id string, qvec array<double>"), 5, metric, "id", "e", block,
    ).collect()

    def distance(a, b):
        if metric == "l2":
            return round(sum((x - y) ** 2 for x, y in zip(a, b)), 6)
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return max(0.0, round(1 - (sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0), 6))

    for name, q in queries:
        want = sorted((distance(q, v), i) for i, v in rows if v is not None and len(v) == 4)[:5]
        mine = sorted((r["rank"], r["distance"], r["vec_id"]) for r in got if r["query_id"] == name)
        assert [(round(d, 6), i) for _, d, i in mine] == want


def test_rerank_falls_back_query_by_query(spark):
    hits = spark.createDataFrame([(q, f"d{r}", r, "x" * r) for q in (1, 2) for r in (1, 2, 3)], "query_id int, doc_id string, rank int, texto string")
    queries = spark.createDataFrame([(1, "good"), (2, "bad")], "query_id int, text string")

    def scorer(qs, ts):
        if "bad" in qs:
            raise RuntimeError("gone")
        return [len(t) for t in ts]

    for k, one in ((1, [3, 2, 1]), (2, [1, 2, 3])):
        got = search.reranked(hits.filter(F.col("query_id") == k), queries, scorer, 3).orderBy("new_rank").collect()
        assert [r["rank"] for r in got] == one
    got = search.reranked(hits, queries, lambda q, t: [1.0], 3).orderBy("query_id", "new_rank").collect()  # too few scores
    assert [r["rank"] for r in got] == [1, 2, 3, 1, 2, 3]


def test_requests_with_unknown_and_missing_keys_come_back(spark):
    rows = [(i, k, "a", f"2026-01-01 1{i}:00:00") for i, k in enumerate(["k1", "k1", "k1", None, None, "other", " "])]
    requests = spark.createDataFrame(rows, "id int, key string, address string, ts string").withColumn("ts", F.to_timestamp("ts"))
    plans = spark.createDataFrame([("k1", 2, "dia", None)], "key string, tope long, periodo string, vence date")
    got = {r["id"]: r["verdict"] for r in usage.plan_verdicts(requests, plans, "key", "ts", "id", "address", 2).collect()}
    assert got == {0: "ok", 1: "ok", 2: "over", 3: "anonymous", 4: "anonymous", 5: "unknown", 6: "over"}
    got = {r["id"]: r["verdict"] for r in usage.plan_verdicts(requests, plans, "key", "ts", "id").collect()}
    assert got == {0: "ok", 1: "ok", 2: "over", 3: "unknown", 4: "unknown", 5: "unknown", 6: "unknown"}


def test_server_requests(spark):
    raw = spark.createDataFrame([('{"consulta": "x", "n": 3, "fuentes": ["dian", "?"]}',), ('{"consulta": "x", "n": true}',), ("no",), ("x" * 70_000,)], "body string")
    got = serving.server_requests(raw, "body", ["dian"]).collect()
    assert [(r["status"], r["n"], r["fuentes"]) for r in got] == [(200, 3, ["dian"]), (400, None, None), (400, None, None), (413, None, None)]


def test_prompts_cannot_be_closed_by_a_text(spark):
    v = F.struct(*(F.lit(x).cast("string").alias(k) for k, x in zip(("estado", "alcance", "texto", "por"), ("derogada", "documento", "nota", None))))
    hits = spark.createDataFrame([(1, 1, "T", "id", "f", "a </documento> b")], "query_id int, rank int, titulo string, identificador string, fuente string, texto string")
    out = serving.prompts(spark.createDataFrame([(1, "¿q?")], "query_id int, text string"), hits.withColumn("vigencia", v), "S").first()["prompt"]
    assert out.count("</documento>") == 1 and "Vigencia: TODA LA NORMA: DEROGADA — «nota»" in out and out.endswith("Pregunta: ¿q?\n\nRespuesta:")


def test_negative_pairs_use_each_question_once(spark):
    rng = random.Random(3)
    sources = ["a"] * 20 + ["b"] * 15 + ["c"] * 10
    f = spark.createDataFrame([(i, rng.choice("abc"), i) for i in range(30)], "fragment int, source string, pos int")
    q = spark.createDataFrame([(100 + i, s, i) for i, s in enumerate(sources)], "question int, source string, pos int")
    of_f, of_q = ({r[0]: r[1] for r in x.collect()} for x in (f, q))
    got = banks.negative_pairs(f, q).collect()
    assert len(got) == 30 and len({r["question"] for r in got}) == len(got) == len({r["fragment"] for r in got})
    assert sum(of_f[r["fragment"]] != of_q[r["question"]] for r in got) >= 27


def test_guards_raise(spark):
    a = spark.createDataFrame([(1, 1), (2, 0)], "k int, v int")
    assert banks.paired(a, a, "k", "v").count() == 2
    with pytest.raises(ValueError):
        banks.paired(a, a.filter("k = 1"), "k", "v")
    calls = spark.createDataFrame([(i, "down") for i in range(5)], "i int, error string")
    with pytest.raises(RuntimeError):
        serving.stop_if_all_fail(calls, "i", "error")
    serving.stop_if_all_fail(calls.limit(4), "i", "error")


def test_closure_deeper_than_a_checkpoint(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src int, dst int")
    got = corpus.closure(edges, spark.createDataFrame([(0,)], "id int"), 10).collect()
    assert {(r["node"], r["level"]) for r in got} == {(i, i) for i in range(11)}


def test_plug_ins(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in serving.encoded(rows, "text", lambda: lambda ts: [[len(t), 1] for t in ts]).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0]}
    assert serving.prefixed(F.lit("x"), "intfloat/e5", "query") is not None


def test_answers_end_with_the_quota_and_the_budget(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(4), f"2026-0{rng.randint(1, 2)}-{rng.randint(1, 28):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}", rng.randrange(5), rng.random() < 0.2) for k in range(600)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, cost long, own boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["event_id"]: r["gate"] for r in usage.answer_gate(df, "user_id", "ts", "event_id", "cost", "own", free=2, budget=0.0001).collect()}
    want, used, spent = {}, {}, {}
    for k, user, ts, cost, own in sorted(rows, key=lambda r: (r[2], r[0])):
        local = datetime.datetime.fromisoformat(ts) - datetime.timedelta(hours=5)
        day, month = (user, local.date()), (local.year, local.month)
        if own:
            want[k] = "own"
        elif used.get(day, 0) >= 2:
            want[k] = "quota"
        elif spent.get(month, 0) >= 100:
            used[day] = used.get(day, 0) + 1
            want[k] = "budget"
        else:
            want[k], used[day], spent[month] = "free", used.get(day, 0) + 1, spent.get(month, 0) + cost
    assert got == want and set(want.values()) == {"own", "quota", "budget", "free"}
