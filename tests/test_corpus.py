"""Usage, corpus, evaluation, sources and streams."""

from __future__ import annotations

import hashlib
import hmac
import io
import json
import math
import random
import zipfile

from pyspark.sql import functions as F

from corvina.functions import tables
from corvina.operators import chunking, corpus, evaluate, pilot, usage
from corvina.sources import binary, connectors
from corvina.streaming import quota


def test_quotas(spark):
    rows = [(i, 1, f"2026-01-01 {10 + i // 6:02d}:{i % 6 * 10:02d}:00") for i in range(5)] + [(9, 1, "2026-01-02 06:00:00"), (10, 1, "2026-01-02 04:59:59")]
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["event_id"]: (r["used"], r["allowed"], r["suggest"]) for r in usage.daily_verdicts(e, soft=1, hard=3).collect()}
    assert got[0] == (1, True, False) and got[2] == (3, True, True) and got[4] == (3, False, False)
    assert got[9] == (1, True, False) and got[10] == (3, False, False)  # the local day ends at 05:00 UTC
    plans = usage.parsed_plans(
        spark.createDataFrame([(1, '{"nombre": "oro", "tope_diario": 2, "vence": "2026-01-01"}'), (2, '{"tope": 0}')], "key long, plan string")
    )
    assert [r["valid"] for r in plans.orderBy("key").collect()] == [True, False]
    p = plans.filter("valid").withColumnRenamed("key", "user_id").select("user_id", "tope", "periodo", "vence")
    keyed = {r["event_id"]: (r["used"], r["allowed"]) for r in usage.plan_verdicts(e, p, "user_id", "ts", "event_id").collect()}
    assert keyed[0] == (1, True) and keyed[3] == (2, False) and keyed[9] == (0, False)


def test_costs(spark):
    df = spark.createDataFrame([("x" * 1000, "gpt-4o"), ("x", "nadie")], "t string, m string")
    a, b = usage.estimated(df, "t", "m").collect()
    assert a["tokens_in"] == 280 and abs(a["usd"] - (280 * 2.5 + 400 * 10) / 1e6) < 1e-12 and a["pesos"] == round(a["usd"] * 4100)
    assert b["usd"] == 0 and "nadie" in b["notice"]


def test_closure_with_cycles_and_fingerprints(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "id long")
    assert {(r["node"], r["level"]) for r in corpus.closure(e, seeds, 5, checkpoint_every=100).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    docs = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id long, text string")
    tree = corpus.fingerprint_tree(docs).first()["fingerprint"]
    assert tree == corpus.fingerprint_tree(docs.repartition(3)).first()["fingerprint"]
    assert tree != corpus.fingerprint_tree(docs.withColumn("text", F.concat("text", F.lit("x")))).first()["fingerprint"]
    assert corpus.contract_violations({"chunk_mode": "a", "header": True}, "b", True, "z") == ["chunk_mode: the index has 'a', asked for 'b'"]


def test_mcnemar(spark):
    rows = [(True, False)] * 9 + [(False, True)] * 2 + [(True, True)] * 5
    got = evaluate.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean")).first()
    want = 2 * sum(math.comb(11, i) for i in range(3)) / 2**11
    assert (got["n10"], got["n01"]) == (9, 2) and abs(got["p"] - want) < 1e-6
    assert evaluate.mcnemar(spark.createDataFrame([(True, True)], "a boolean, b boolean")).first()["p"] == 1.0


def test_recall(spark):
    gold = spark.createDataFrame([(1, 10, "d1", "p"), (2, 20, "", "q"), (3, 30, "d3", "q")], "query_id int, gold_id long, gold_document string, perfil string")
    hits = spark.createDataFrame([(1, 11, "d1", 2), (2, 21, "", 1), (3, 30, "z", 7)], "query_id int, doc_id long, document string, rank int")
    got = evaluate.recall(evaluate.first_hits(gold, hits, 10), [1, 5, 10], 10, []).first()
    assert (got["recall_1"], got["recall_5"], got["recall_10"]) == (0.0, 0.333333, 0.666667)
    assert abs(got["mrr_10"] - (1 / 2 + 1 / 7) / 3) < 1e-6


def test_negatives_and_bridge(spark):
    t = spark.createDataFrame([(1, 1.0, [("a", 0.96), ("b", 0.5)]), (2, -1.0, [("a", -1.0)])], "query_id int, positive_score double, negatives array<struct<id: string, score: double>>")
    got = {r["query_id"]: [x["id"] for x in r["negatives"]] for r in evaluate.clean_negatives(t).collect()}
    assert got == {1: ["b"]}
    q = spark.createDataFrame([(1, ["echaron", "ayer"])], "query_id int, terms array<string>")
    assert evaluate.expanded_terms(q, {"echaron": ("despido", "terminacion ayer")}).first()["terms"] == ["echaron", "ayer", "despido", "terminacion"]
    curve = spark.createDataFrame([(0.1, 0.9, 0.7), (0.5, 0.4, 0.95)], "threshold double, coverage double, precision double")
    assert {r["level"]: r["coverage"] for r in evaluate.best_coverage(curve, [0.6, 0.9]).collect()} == {0.6: 0.9, 0.9: 0.4}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": {"hits": {"hits": [
        {"_id": "1", "_source": {"prov_sentencia": "C-1-20", "prov_sintesis": "texto de la decisiÃ³n", "prov_tema": "t"}},
        {"_id": "2", "_source": {"prov_sentencia": "C-2-20", "prov_sintesis": "Sin información"}}]}}}))
    got = connectors.court_hits(spark, str(tmp_path / "a.json")).collect()
    assert [(r["identificador"], r["texto"]) for r in got] == [("C-1-20", "texto de la decisión")]
    (tmp_path / "ley.md").write_text('---\ntitle: "Ley 1"\nidentifier: LEY-1-1873\nrank: ley\npublication_date: 1873-01-01\n---\n' + "cuerpo " * 10)
    md = connectors.markdown_laws(spark, str(tmp_path / "ley.md")).first()
    assert (md["id"], md["titulo"], md["fecha"]) == ("legalize_co_github:LEY-1-1873", "Ley 1", "1873-01-01")
    html = "<html><head><title>Decreto 5</title><script>x()</script></head><body><p>Dado el 3 de marzo de 2001</p>" + "<p>hola</p>" * 60
    html += '<a href="norma.php?i=77">Modificado por el Decreto 9</a></body></html>'
    pages = spark.createDataFrame([(1, html), (2, "<p>corto</p>"), (3, None)], "page_id long, html string")
    parsed = connectors.html_documents(pages)
    r = parsed.first()
    assert parsed.count() == 1 and r["titulo"] == "Decreto 5" and "x()" not in r["texto"] and r["fecha"] == "2001-03-03"
    assert [tuple(e) for e in connectors.relation_edges(parsed).collect()] == [(1, "77", "Modificado por")]
    files = spark.createDataFrame([(bytearray(b"PK\x03\x04x"),), (bytearray(b"%PDF-1.4"),), (bytearray("texto áé".encode("latin-1")),), (bytearray(bytes(range(9)) * 50),)], "c binary")
    assert [r[0] for r in files.select(connectors.binary_kind(F.col("c"))).collect()] == ["zip", "pdf", "text", "unknown"]
    assert files.select(binary.file_text(F.col("c"))).collect()[2][0] == "texto áé"
    names = spark.createDataFrame([("x/a.pdf",), ("x/a.docx",), ("x/b.pdf",)], "p string")
    assert sorted(r["p"] for r in binary.one_per_stem(names, "p").collect()) == ["x/a.docx", "x/b.pdf"]


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "id long, t string").write.parquet(path)
    more = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    assert connectors.append_pending(more, path, "id") == 2 and connectors.append_pending(more, path, "id") == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, f"2026-01-0{1 + i % 2} 1{i % 10}:00:00") for i in range(40)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = quota.run_once(quota.verdicts(stream, hard=3, soft=2), spark, str(tmp_path / "out"), str(tmp_path / "cp"))
    want = usage.daily_verdicts(e, hard=3, soft=2)
    cols = ["event_id", "used", "allowed", "suggest"]
    key = lambda d: sorted((r[0], int(r[1]), r[2], r[3]) for r in d.select(*cols).collect())
    assert key(got) == key(want)


def test_entry_imports_without_the_subpackage():
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['corvina.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert 'rrf_hybrid' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    )
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def word_file(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{binary.WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_texts_of_binary_files(spark, tmp_path):
    run = "<w:r><w:t>{}</w:t></w:r>"
    body = f"<w:p>{run.format('Uno')}<w:r><w:tab/><w:t> dos</w:t><w:br/></w:r></w:p><w:p/><w:p>{run.format('  ')}</w:p><w:tbl><w:p>{run.format('no')}</w:p></w:tbl><w:p><w:hyperlink>{run.format('tres &amp; más')}</w:hyperlink></w:p>"
    assert binary.docx_text(word_file(body)) == "Uno\t dos\n\ntres & más"
    assert binary.docx_text(b"PK\x03\x04 broken") is None and binary.docx_text(word_file("<w:p>")) is None
    late = b"a" * 20000 + bytes(range(9)) * 400 + b"a" * 20000  # the middle alone gives it away
    given = {
        "a.docx": word_file(body), "a.pdf": b"%PDF-1.4 x", "a.txt": b"other", "b.txt": "ñandú".encode(), "c.txt": "ñandú".encode("latin-1"), "d.mp3": b"ID3 all text",
        "e.bin": late, "f.txt": b"x" * 2_000_001, "g.wav": b"RIFF1234", "h": b"",
    }
    for name, content in given.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["texto"]) for r in binary.binary_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("zip", "Uno\t dos\n\ntres & más"), "b.txt": ("text", "ñandú"), "c.txt": ("text", "ñandú")}


def test_the_table_function_makes_the_same_fragments(spark):
    rng = random.Random(6)
    blocks = ["ARTÍCULO 1º. Objeto.", "Comuníquese y cúmplase.", "COMUNÍQUESE Y CÚMPLASE", "Dado en Bogotá, a los tres días", " ", "x" * 1600, "EL PRESIDENTE\nfirma", "Artículo 22 otra cosa"]
    texts = ["\n".join(rng.choice([*blocks, "palabra " * rng.randint(1, 120), "\n\n"]) for _ in range(rng.randint(0, 14))) for _ in range(150)] + [None, "", " \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tables.register(spark)
    for mode in ("paragraphs", "size"):
        want = sorted(map(tuple, chunking.fragments(df, mode).select("document_id", "ord", "text").collect()))
        got = spark.sql(f"SELECT d.id, f.ord, f.fragment FROM {{df}} d, LATERAL fragments(d.text, '{mode}') f", df=df)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_harvest_of_two_levels(spark):
    s = [("a", 0, "A b c d"), ("a", 1, "too short"), ("puedo a", 0, "a b c d"), ("puedo a", 1, "basura e f g"), ("b", 0, "h i j k"), ("a b c d", 0, "l m n o"), ("a b c d", 1, "h i j k"), ("h i j k", 0, "p q r s")]
    suggestions = spark.createDataFrame(s, "asked string, pos int, suggestion string")
    seeds = spark.createDataFrame([("a", 0), ("b", 1)], "seed string, pos int")
    run = lambda **k: sorted(map(tuple, connectors.harvested(suggestions, seeds, ("puedo",), "basura", **k).collect()))
    assert run() == [("a b c d", "a", 0), ("h i j k", "b", 0), ("l m n o", "a", 1), ("p q r s", "b", 1)]
    assert run(deepen=1) == [("a b c d", "a", 0), ("h i j k", "b", 0), ("l m n o", "a", 1)]
    assert run(requests=2) == [("a b c d", "a", 0)]
    assert run(requests=5) == [("a b c d", "a", 0), ("h i j k", "b", 0), ("l m n o", "a", 1)]


def test_fingerprints_of_addresses(spark):
    want = "ip:" + hmac.new(b"sal", "10.0.0.1".encode(), hashlib.sha256).hexdigest()[:32]
    got = spark.createDataFrame([("10.0.0.1",), (None,)], "a string").select(pilot.address_print(F.col("a"), "sal")).collect()
    assert [r[0] for r in got] == [want, None]


def test_court_hits_come_in_few_files(spark, tmp_path):
    from corvina.plans import register, register_legal  # noqa: F401  (the second adds to the first)

    texts = [" Texto de la sentencia ", "sin información", "", None, "otro"]
    rows = [(k // 3, k % 3, "user", texts[k % 5]) for k in range(2500)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    c.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    out = register.QUERIES["court_hits"](spark, str(tmp_path))
    assert len(out.inputFiles()) <= 3  # a file for each row before
    want = {f"C-{a}/{b}": t.strip() for a, b, _, t in rows if a % 3 and t and t.strip() not in ("", "sin información")}
    assert {r["identificador"]: r["texto"] for r in out.collect()} == want and out.count() == len(want)
