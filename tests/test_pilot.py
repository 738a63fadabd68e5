from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import functions as F

from corvina.operators import evaluate, pilot


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], list(given)).select(column.alias("x")).first()["x"]


def test_bridge(spark):
    assert len(pilot.BRIDGE) == 46
    q = spark.createDataFrame([(1, ["jefe", "echaron"])], "query_id int, terms array<string>")
    assert evaluate.expanded_terms(q, pilot.BRIDGE).first()["terms"] == [
        "jefe", "echaron", "empleador", "patrono", "despido", "terminacion", "unilateral", "contrato",
    ]


def test_rewriting(spark):
    f = lambda p: value(spark, pilot.rewritten(F.col("o"), F.col("p")), o="me echaron ayer", p=p)
    assert f("Términos: despido sin justa causa\nexplico más") == "despido sin justa causa"
    assert f("uno dos uno dos uno dos uno dos") == "me echaron ayer"
    assert f("corto") == "me echaron ayer" and f("") == "me echaron ayer"
    assert f("Despido despido indirecto laboral") == "Despido indirecto laboral"


def test_answers(spark):
    trap = "Decreto 150 de 1997, artículo 9 — INEXEQUIBLE"
    f = lambda a: value(spark, pilot.fell_into_trap(F.col("a"), F.col("t")), a=a, t=trap)
    assert f("Según el DECRETO 150 de 1997 se paga.") is True
    assert f("El Decreto 150 de 1997 fue derogado.") is False
    assert f("El Decreto 150 de 1997 rigió hasta 2001.") is False
    assert f("El Decreto 9 de 1997.") is False
    long = "La Ley 1 dice «texto literal de la norma» " + "y sigue " * 30
    assert value(spark, pilot.has_format(F.col("a")), a=long) is True and value(spark, pilot.has_format(F.col("a")), a="La Ley 1") is False
    rows = spark.createDataFrame([(long, None, False, 1, 1, "a"), ("No encontré información suficiente", trap, True, 0, 0, "b")], "respuesta string, trampa string, debe_abstenerse boolean, buenas int, total int, perfil string")
    whole = pilot.pilot_report(rows, ["perfil"]).filter("perfil is null").first()
    assert (whole["n"], whole["literal_rate"], whole["format_rate"], whole["due_abstention"], whole["traps_avoided"]) == (2, 1.0, 0.5, 1.0, 1.0)


def test_choice_and_hmac(spark):
    assert value(spark, pilot.ranked_choice(F.col("a"), F.lit(30)), a="Elijo 3, 99, 3 y 12; luego 0 y 7") == [3, 12, 7]
    want = hmac.new(b"sal", "1.2.3.4 ñ".encode(), hashlib.sha256).hexdigest()
    assert value(spark, pilot.hmac_sha256(F.col("m"), "sal"), m="1.2.3.4 ñ") == want
