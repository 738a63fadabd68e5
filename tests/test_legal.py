"""Chunking, validity, grounding and routing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvina.operators import chunking, grounding, routing, validity


def cut(spark, text, mode="paragraphs"):
    df = spark.createDataFrame([("d", text)], "id string, text string")
    return [r["text"] for r in chunking.fragments(df, mode).orderBy("ord").collect()]


def test_articles(spark):
    got = cut(spark, "ARTÍCULO 1. Uno.\nArtículo 2o. Dos.\nArticulo 3 Tres.")
    assert [g[:10].lower()[-1] for g in got] == ["1", "2", "3"]


def test_windows_and_paragraphs(spark):
    long = "palabra " * 1000
    assert all(len(g) <= 1500 for g in cut(spark, long)) and len(cut(spark, long)) == 6
    blocks = [("a" * 16), "b" * 1400, "c" * 25, "d" * 2000, "e" * 20]
    got = cut(spark, "\n\n".join(blocks))
    assert all(len(g) <= 1500 for g in got)
    for c in "abcde":
        assert sum(g.count(c) for g in got) >= dict(zip("abcde", map(len, blocks)))[c]
    with pytest.raises(ValueError):
        chunking.fragments(spark.createDataFrame([("d", "x")], "id string, text string"), "otro")


def test_closing_formulas(spark):
    body = "Considerando que confirma lo dicho. " * 20
    assert "firma el ministro" not in cut(spark, body + "\nCOMUNÍQUESE Y CÚMPLASE\nfirma el ministro")[-1]
    early = "COMUNÍQUESE Y CÚMPLASE\n" + body
    assert "".join(cut(spark, early)).count("confirma") == 20
    assert cut(spark, "CÚMPLASE") == ["CÚMPLASE"]
    assert cut(spark, "") == []
    assert cut(spark, body + "\nDADO EN Bogotá a los tres días")[-1].endswith("dicho.")


NOTES = [
    ("<Artículo derogado por el artículo 5 de la Ley 1 de 1990>", "derogada", "parcial"),
    ("<Decreto derogado por la Ley 2>", "derogada", "documento"),
    ("<Ley INEXEQUIBLE>", "inexequible", "documento"),
    ("<Aparte tachado INEXEQUIBLE>", "inexequible", "parcial"),
    ("<NOTA DE VIGENCIA: Concepto revocado por el Oficio 3>", "revocada", "documento"),
    ("NOTA DE VIGENCIA: Resolución suspendida provisionalmente", "suspendida", "documento"),
    ("<Derogado por el artículo 9>", "derogada", "parcial"),
    ("<Decreto 65 de 2005 declarado nulo>", "nula", "documento"),
    ("<Parágrafo declarado inexequible>", "inexequible", "parcial"),
]


@pytest.mark.parametrize(("text", "state", "scope"), NOTES)
def test_notes(spark, text, state, scope):
    df = spark.createDataFrame([(text,)], "t string").select(validity.notes(F.col("t")).alias("n"))
    (note,) = df.first()["n"]
    assert (note["estado"], note["alcance"]) == (state, scope)


@pytest.mark.parametrize("text", ["<b>negrita</b>", "la ley fue derogada", "<Ver Decreto 5>", ""])
def test_no_notes(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(validity.notes(F.col("t")).alias("n")).first()["n"] == []


def test_validity_table_and_annotation(spark):
    rows = [
        ("dian:decreto_0065_2005::frag0", "<Decreto 2788 de 2004 derogado por el Decreto 4>"),
        ("dian:decreto_0150_1997::frag0", "<Decreto 150 de 1997 derogado por la Ley 3>"),
        ("dian:decreto_0150_1997::frag1", "<Artículo INEXEQUIBLE>"),
        ("x:LEY-33-1986::frag0", "texto sin nota"),
        ("x:otra::frag0", "nada"),
    ]
    f = spark.createDataFrame(rows, "id string, texto string")
    records = spark.createDataFrame(
        [("Ley", "0033", "1986", " Derogado "), ("LEY", "5", "1999", "Derogado"), ("LEY", "5", "1999", "declarado nulo"), ("LEY", "6", "1999", "Vigente")],
        "tipo string, n_mero string, a_o string, vigencia string",
    )
    official = validity.catalogue_notes(records)
    assert {(r["number"], r["note"]["estado"]) for r in official.collect()} == {("33", "derogada"), ("5", "incierta")}
    table = validity.validity_table(f, official)
    assert {r["document_id"]: r["estado"] for r in table.collect()} == {
        "dian:decreto_0065_2005": "incierta", "dian:decreto_0150_1997": "derogada", "x:LEY-33-1986": "derogada",
    }
    got = {r["id"]: (r["vigencia"]["estado"], r["vigencia"]["alcance"]) for r in validity.annotate(f, table).collect()}
    assert got["dian:decreto_0150_1997::frag1"] == ("derogada", "documento")
    assert got["dian:decreto_0065_2005::frag0"] == ("incierta", "documento")
    assert got["x:otra::frag0"] == ("sin_nota", None)


def test_warning(spark):
    f = spark.createDataFrame([("a:ley-1-2000::frag0", "<Ley INEXEQUIBLE>")], "id string, texto string")
    hits = validity.annotate(f, validity.validity_table(f)).select(F.lit(1).alias("query_id"), F.lit(1).alias("rank"), F.lit("Ley 1").alias("titulo"), "vigencia")
    answers = spark.createDataFrame([(1, "La ley dice algo."), (2, "otra")], "query_id int, respuesta string")
    got = {r["query_id"]: r["warned"] for r in validity.with_warning(answers, hits).collect()}
    assert got[1].startswith("⚠ ADVERTENCIA") and "- Ley 1: INEXEQUIBLE" in got[1] and got[2] == "otra"
    quiet = spark.createDataFrame([(1, "Esa ley fue derogada.")], "query_id int, respuesta string")
    assert validity.with_warning(quiet, hits).first()["warned"] == "Esa ley fue derogada."


FRAGMENTS = [("DECRETO-1713-2002", "Decreto 1713", "El artículo 24 del Decreto 1713 de 2002 fija un plazo de treinta (30) días para el aprovechamiento.")]


def ground(spark, answer):
    df = spark.createDataFrame([(answer, FRAGMENTS)], "a string, f array<struct<identificador: string, titulo: string, texto: string>>")
    checked = grounding.verified(F.col("a"), F.col("f"))
    return df.select(
        checked.alias("v"), grounding.literal_quotes(F.col("a"), F.col("f.texto")).alias("q"), grounding.support_verdict(F.col("a"), F.col("f.texto")).alias("s"),
        grounding.marked(F.col("a"), checked).alias("m"), grounding.mark_quotes(F.col("a"), F.col("f.texto")).alias("mq"),
        grounding.unsupported_sentences(F.col("a"), checked).alias("u"), grounding.attribution(F.col("a"), F.col("f")).alias("at"),
    ).first()


def test_grounding(spark):
    r = ground(spark, "El Decreto 1713 de 2002, artículo 24, fija algo. La Ley 999 de 2010 lo cambia.")
    assert [(c["tipo"], c["respaldada"]) for c in r["v"]] == [("norma", True), ("norma", False), ("articulo", True)]
    assert "⚠[Ley 999 de 2010: no está en las fuentes citadas]" in r["m"] and r["u"] == ["La Ley 999 de 2010 lo cambia."]
    assert r["at"] == []  # number and two-digit year must be neighbours, so a four-digit year names no fragment
    r = ground(spark, "Según DECRETO-1713-2002, el artículo 24 da 45 días. La Ley 5 de 2000 no.")
    assert [(a["citado"], [c["respaldada"] for c in a["afirmaciones"]]) for a in r["at"]] == [("DECRETO-1713-2002", [True, False])]


def test_literal_quotes(spark):
    r = ground(spark, "Dice «fija un plazo de treinta (30) días» y «esto no aparece en ninguna parte».")
    assert tuple(r["q"]) == (1, 2) and r["s"]["aceptada"] is False and r["mq"].count("⚠") == 1
    r = ground(spark, "Dice «El artículo 24 del Decreto [...] para el aprovechamiento».")
    assert tuple(r["q"]) == (1, 1) and r["s"]["aceptada"] is True
    assert ground(spark, "No encontré información suficiente.")["s"]["motivo"].startswith("Los fragmentos")
    assert ground(spark, "Sin citas.")["s"]["aceptada"] is False


def test_router(spark):
    q = spark.createDataFrame([(i,) for i in range(1, 7)], "query_id int")
    hits = [(2, 1, 0.05, True), (3, 1, 0.0167, False), (4, 1, 0.06, False), (4, 2, 0.03, False), (5, 1, 0.03, False), (5, 2, 0.029, False), (6, 1, 0.03, True), (6, 2, 0.02, False)]
    h = spark.createDataFrame(hits, "query_id int, rank int, score double, not_valid boolean")
    got = {r["query_id"]: r["motor"] for r in routing.decide(q, h, external_key=True).collect()}
    assert got == {1: "abstenerse", 2: "abstenerse", 3: "condicional", 4: "local", 5: "externo", 6: "externo"}
    assert {r["motor"] for r in routing.decide(q, h).filter("query_id = 5").collect()} == {"local"}
    assert "1.234 fragmentos" in routing.abstention_message(1234)


def test_notes_by_rows_are_the_notes_by_arrays(spark):
    marks = [
        "<Artículo derogado por el artículo 5 de la Ley 1 de 2000>", "<Ley derogada por la Ley 9 de 1999>", "NOTA DE VIGENCIA: Derogado por Ley 3 de 2001.\n", "<b>texto</b>",
        "<Decreto declarado nulo por el Consejo de Estado>", "<Modificado por el Decreto 4 de 2010>", "sin marca", "<>", "< >",
    ]
    texts = [" ".join(marks[(i * k + k) % len(marks)] for k in range(i % 5)) for i in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, t string, other string")
    arrays = df.select("id", F.posexplode(validity.all_notes(F.col("t"))).alias("pos", "note")).filter("note.alcance is not null and note.texto <> ''")
    rows = validity.read_notes(df, "t")
    assert rows.columns == ["id", "other", "pos", "note"]
    got = sorted(map(str, rows.select("id", "pos", "note").collect()))
    assert got == sorted(map(str, arrays.select("id", "pos", "note").collect())) and len(got) > 40
