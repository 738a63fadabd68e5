"""Registered queries of sources, validity, grounding and pilots, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corvina.functions import tables
from corvina.functions import text as tx
from corvina.operators import chunking, corpus, evaluate, grounding, lexical, pilot, routing, usage, validity
from corvina.plans.register import STOP, bm25_sql, docs, qterms, query, toks
from corvina.plans.register_serving import note
from corvina.session import table
from corvina.shared import numbered, shared_path, staged
from corvina.sources import binary, connectors
from corvina.streaming import quota

# --- validity -------------------------------------------------------------------

STATES = ("Vigente", "Derogado", "No vigente", "Declarado inexequible", "Derogado parcialmente", "Suspendido provisionalmente")
STATES_SQL = "[" + ", ".join(f"'{x}'" for x in STATES) + "]"
CATALOGUE_SQL = f"""c AS (SELECT DISTINCT 'LEY' AS kind, (o_custkey % 300)::VARCHAR AS number, strftime(o_orderdate, '%Y') AS year, lower(({STATES_SQL})[(o_orderkey % 6)::INT + 1]) AS state FROM orders),
    k AS (SELECT kind, number, year, list(state ORDER BY state) AS s FROM c WHERE state <> 'vigente' GROUP BY ALL),
    n AS (SELECT kind, number, year, CASE WHEN len(s) > 1 THEN 'incierta' WHEN s[1] IN ('derogado', 'no vigente', 'derogado parcialmente') THEN 'derogada'
        WHEN s[1] = 'declarado inexequible' THEN 'inexequible' ELSE 'suspendida' END AS estado, CASE WHEN len(s) = 1 AND s[1] = 'derogado parcialmente' THEN 'parcial' ELSE 'documento' END AS alcance,
        CASE WHEN len(s) > 1 THEN 'SUIN-Juriscol: normas homónimas con vigencias distintas (' || array_to_string(s, ', ') || ')'
        ELSE 'SUIN-Juriscol: ' || upper(s[1][1]) || s[1][2:] END AS texto FROM k)"""


def catalogue_records(spark, d):
    state = F.array(*map(F.lit, STATES))[(F.col("o_orderkey") % 6).cast("int")]
    return table(spark, d, "orders").select(
        F.lit("Ley").alias("tipo"), F.concat(F.lit(" 00"), (F.col("o_custkey") % 300).cast("string")).alias("n_mero"), F.date_format("o_orderdate", "yyyy").alias("a_o"), state.alias("vigencia")
    )


@query(f"WITH {CATALOGUE_SQL} SELECT kind, number, year, estado, alcance, texto FROM n")
def catalogue_notes(spark, d):
    return validity.catalogue_notes(catalogue_records(spark, d)).select("kind", "number", "year", "note.estado", "note.alcance", "note.texto")


@query(
    f"""WITH {CATALOGUE_SQL}, f AS (SELECT DISTINCT 'suin:ley-' || (o_custkey % 300) || '-' || strftime(o_orderdate, '%Y') AS document_id, (o_custkey % 300)::VARCHAR AS number, strftime(o_orderdate, '%Y') AS year FROM orders),
    own AS (SELECT document_id, number::BIGINT % 4 = 0 AS gone FROM f)
    SELECT f.document_id, CASE WHEN gone AND coalesce(estado, '') <> 'inexequible' THEN 'derogada' ELSE estado END AS estado, CASE WHEN gone AND coalesce(estado, '') NOT IN ('inexequible') THEN 'Ley derogada' ELSE texto END AS texto
    FROM f JOIN own USING (document_id) LEFT JOIN n ON n.number = f.number AND n.year = f.year WHERE gone OR estado IS NOT NULL"""
)
def validity_with_catalogue(spark, d):
    key = F.concat(F.lit("suin:ley-"), (F.col("o_custkey") % 300).cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyyy"))
    text = F.when(F.col("o_custkey") % 300 % 4 == 0, "<Ley derogada> texto").otherwise("texto")
    fragments = table(spark, d, "orders").select(F.concat(key, F.lit("::frag0")).alias("id"), text.alias("texto")).distinct()
    return validity.validity_table(fragments, validity.catalogue_notes(catalogue_records(spark, d))).select("document_id", "estado", "texto")


@query("SELECT o_orderkey, 'DECRETO' AS kind, (o_custkey)::VARCHAR AS number, strftime(o_orderdate, '%Y') AS year FROM orders WHERE o_orderkey % 3 = 0")
def norm_keys(spark, d):
    i, y = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    ident = F.when(i % 3 == 0, F.concat(F.lit("dian:Decreto_00"), F.col("o_custkey").cast("string"), F.lit("_"), y)).when(i % 3 == 1, F.concat(F.lit("x:oficio_1_"), y)).otherwise("ley-1")
    out = table(spark, d, "orders").select("o_orderkey", validity.norm_key(ident).alias("k")).filter("k is not null")
    return out.select("o_orderkey", "k.kind", "k.number", "k.year")


@query(
    """WITH m AS (SELECT conv_id, string_agg('- ' || role || turn || ': DEROGADA (nota oficial: «n' || turn || '»)', chr(10) ORDER BY turn) FILTER (rn <= 3) AS lines
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE turn % 2 = 0) GROUP BY conv_id)
    SELECT item_id AS query_id, CASE WHEN lines IS NULL OR item_id % 4 = 0 THEN a ELSE '⚠ ADVERTENCIA DE VIGENCIA: parte de lo que se usó para esta respuesta NO está vigente según su propia nota oficial. No la apliques sin verificar la norma que la reemplazó.'
        || chr(10) || lines || chr(10) || chr(10) || a END AS warned FROM (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'La ley fue derogada.' ELSE text END AS a FROM benchmark) LEFT JOIN m ON conv_id = item_id"""
)
def validity_warning(spark, d):
    t = F.col("turn")
    hits = table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), t.alias("rank"), F.concat("role", t.cast("string")).alias("titulo"),
        note(F.when(t % 2 == 0, "derogada").otherwise("incierta"), "documento", F.concat(F.lit("n"), t.cast("string"))).alias("vigencia"),
    )
    said = F.when(F.col("item_id") % 4 == 0, "La ley fue derogada.").otherwise(F.col("text"))
    answers = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), said.alias("respuesta"))
    return validity.with_warning(answers, hits).select("query_id", "warned")


@query("SELECT estado, count(*) AS n FROM (SELECT ['derogada', 'nula', 'incierta'][(doc_id % 3)::INT + 1] AS estado FROM documents) GROUP BY 1")
def validity_histogram(spark, d):
    state = F.array(*map(F.lit, ("derogada", "nula", "incierta")))[(F.col("doc_id") % 3).cast("int")]
    out = connectors.write_validity(docs(spark, d).select(F.col("doc_id").alias("document_id"), state.alias("estado")), shared_path(spark, "validity"))
    return out.withColumnRenamed("count", "n")


# --- grounding and pilots -------------------------------------------------------

ANSWER_SQL = "'Según la Ley ' || (10000 + doc_id % 90000) || ' de 2004 el plazo es de ' || (doc_id % 50) || ' días. La circular ' || CASE WHEN doc_id % 7 = 3 THEN 'tercera' ELSE 'otra' END || ' dice el ' || (doc_id % 9) || ' %.'"


def answers(spark, d):
    i = F.col("doc_id")
    said = F.concat(
        F.lit("Según la Ley "), (10000 + i % 90000).cast("string"), F.lit(" de 2004 el plazo es de "), (i % 50).cast("string"), F.lit(" días. La circular "),
        F.when(i % 7 == 3, "tercera").otherwise("otra"), F.lit(" dice el "), (i % 9).cast("string"), F.lit(" %."),
    )
    frag = lambda name, t: F.struct(F.lit(name).alias("identificador"), F.lit("t").alias("titulo"), t.alias("texto"))
    law = frag("norma cuarta", F.when(i % 2 == 0, F.concat(F.lit("Ley "), (10000 + i % 90000).cast("string"), F.lit(" de 2004"))).otherwise("nada"))
    circular = frag("circular tercera", F.concat(F.lit("un "), (i % 9).cast("string"), F.lit(" por ciento")))
    return docs(spark, d).select("doc_id", said.alias("respuesta"), F.array(law, circular).alias("frags"))


@query(
    f"""SELECT doc_id, 1 AS n, CASE WHEN doc_id % 2 = 1 THEN replace(a, l, '⚠[' || l || ': no está en las fuentes citadas]') ELSE a END AS marked
    FROM (SELECT doc_id, {ANSWER_SQL} AS a, 'Ley ' || (10000 + doc_id % 90000) || ' de 2004' AS l FROM documents)"""
)
def unsupported_marked(spark, d):
    rows = answers(spark, d)
    checked = rows.withColumn("c", grounding.verified(F.col("respuesta"), F.col("frags")))
    only = F.filter("c", lambda c: (c["tipo"] == "norma") & F.startswith(c["texto"], F.lit("Ley")))
    return checked.select("doc_id", F.size(only).alias("n"), grounding.marked(F.col("respuesta"), only).alias("marked"))


@query(
    """SELECT doc_id, unnest(CASE WHEN doc_id % 7 = 3 THEN [{'frase': 2, 'citado': 'circular tercera', 'n': 1}] ELSE [] END, recursive := true) FROM documents"""
)
def attributed_claims(spark, d):
    rows = answers(spark, d).select("doc_id", "respuesta", F.explode(grounding.attribution(F.col("respuesta"), F.col("frags"))).alias("r"))
    place = F.array_position(tx.sentences(F.col("respuesta")), F.col("r.frase")).cast("int")
    return rows.select("doc_id", place.alias("frase"), F.col("r.citado").alias("citado"), F.size("r.afirmaciones").alias("n"))


@query(
    """SELECT doc_id, doc_id % 4 = 0 AS aceptada, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Los fragmentos encontrados no responden la consulta.'
        WHEN 2 THEN 'La respuesta no cita textualmente ninguna norma de las encontradas.' ELSE '1 de 2 citas de la respuesta no aparecen literalmente en las fuentes encontradas.' END AS motivo FROM documents"""
)
def support_verdicts(spark, d):
    i = F.col("doc_id") % 4
    source = F.array(F.lit("El contrato de trabajo termina por mutuo acuerdo de las partes."))
    good = "«termina por mutuo acuerdo de las partes»"
    said = F.when(i == 0, f"Dice {good}.").when(i == 1, "No encontré información suficiente.").when(i == 2, "Dice que termina.").otherwise(f"Dice {good} y «esto no lo dice nadie nunca».")
    return docs(spark, d).select("doc_id", grounding.support_verdict(said, source).alias("v")).select("doc_id", "v.aceptada", "v.motivo")


@query(
    """SELECT lang, count(*) AS n, round(sum(doc_id % 3)::DOUBLE / sum(3), 6) AS literal_rate, round(avg((doc_id % 2 = 0)::INT), 6) AS format_rate,
        round(avg(CASE WHEN doc_id % 5 = 0 THEN (doc_id % 2 = 1)::INT END), 6) AS due_abstention, round(avg(CASE WHEN doc_id % 7 = 0 THEN (doc_id % 2 = 1)::INT END), 6) AS traps_avoided
    FROM documents GROUP BY GROUPING SETS ((), (lang))"""
)
def pilot_report(spark, d):
    i = F.col("doc_id")
    long = "Según la Ley 100 de 1993, el texto dice «la pensión se reconoce por vejez» y además explica con detalle los requisitos que deben cumplirse, los plazos, las autoridades competentes y los recursos que proceden contra la decisión."
    rows = docs(spark, d).select(
        "lang", F.when(i % 2 == 0, long).otherwise("No está en el índice.").alias("respuesta"), F.when(i % 7 == 0, "La Ley 100 de 1993 ya no rige").alias("trampa"),
        (i % 5 == 0).alias("debe_abstenerse"), (i % 3).alias("buenas"), F.lit(3).alias("total"),
    )
    return pilot.pilot_report(rows, ["lang"])


@query(
    "SELECT item_id, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN 'despido sin justa causa' WHEN 2 THEN text ELSE 'pension vejez requisitos' END AS terms FROM benchmark"
)
def rewritten_queries(spark, d):
    i = F.col("item_id") % 4
    said = F.when(i == 0, "dos palabras").when(i == 1, "Términos: «despido sin justa causa»\nmás").when(i == 2, "a a a a b").otherwise('"pension vejez Pension requisitos"')
    return table(spark, d, "benchmark").select("item_id", pilot.rewritten(F.col("text"), said).alias("terms"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '3,1' || CASE WHEN item_id % 9 IN (0, 2) THEN '' ELSE ',' || (1 + item_id % 9) END ELSE '' END AS picks FROM benchmark")
def ranked_choices(spark, d):
    i = F.col("item_id")
    said = F.when(i % 2 == 0, F.concat(F.lit("[3] luego 1 y 99, 3, "), (1 + i % 9).cast("string"))).otherwise("ninguno 0")
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.transform(pilot.ranked_choice(said, F.lit(10)), lambda x: x.cast("string")), ",").alias("picks"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ['me', 'echaron'] WHEN 1 THEN ['sueldo', 'plata', 'pago'] ELSE ['nada'] END AS l FROM conversations)
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'me echaron despido terminacion unilateral contrato' WHEN 1 THEN 'sueldo plata pago salario remuneracion dinero suma' ELSE 'nada' END AS terms FROM t"""
)
def bridged_terms(spark, d):
    t = F.col("turn") % 3
    given = F.when(t == 0, F.array(F.lit("me"), F.lit("echaron"))).when(t == 1, F.array(F.lit("sueldo"), F.lit("plata"), F.lit("pago"))).otherwise(F.array(F.lit("nada")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", given.alias("terms"))
    return evaluate.expanded_terms(rows, pilot.BRIDGE).select("conv_id", "turn", F.array_join("terms", " ").alias("terms"))


@query("SELECT doc_id, len(x) AS n, x[1] AS first FROM (SELECT doc_id, list_filter([doc_id % 10, doc_id % 20, 15], lambda s: s < (doc_id % 12 + 8) * 0.95) AS x FROM labels) WHERE len(x) > 0")
def cleaned_negatives(spark, d):
    i = F.col("doc_id")
    neg = F.array(*(F.struct(F.lit(k).alias("id"), s.cast("double").alias("score")) for k, s in enumerate((i % 10, i % 20, F.lit(15)))))
    out = evaluate.clean_negatives(table(spark, d, "labels").select("doc_id", (i % 12 + 8).cast("double").alias("positive_score"), neg.alias("negatives")))
    return out.select("doc_id", F.size("negatives").cast("long").alias("n"), F.col("negatives")[0]["score"].cast("long").alias("first"))


@query(
    f"""SELECT item_id, array_to_string(list_transform(f[1:12], lambda t: '"' || t || '"'), ' OR ') AS expression FROM (SELECT item_id,
        list_filter(u, lambda t, i: list_position(u, t) = i) AS f FROM (SELECT item_id, list_filter({toks('text')}, lambda t: length(t) >= 3 AND NOT list_contains({STOP}, t)) AS u FROM benchmark))"""
)
def fts_expressions(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.fts_expression(tx.query_terms(F.col("text"))).alias("expression"))


BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(
    rf"""WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g'), '([.;:]){BLANK}+', '\1' || chr(2), 'g'), chr(2)) AS s FROM documents)
    SELECT doc_id, len(f) AS n, md5(array_to_string(f, chr(2))) AS h FROM (SELECT doc_id, list_filter(s, lambda x: regexp_replace(x, '{BLANK}+', '', 'g') <> '') AS f FROM t)"""
)
def sentence_split(spark, d):
    rows = docs(spark, d).select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\x02")).alias("h"))


SALT = "sal-del-2026-09-06"
PADS = [bytes(b ^ pad for b in SALT.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(f"SELECT conv_id, turn, 'ip:' || substr(sha256(unhex('{PADS[1]}') || unhex(sha256(unhex('{PADS[0]}') || encode(text)))), 1, 32) AS print FROM conversations")
def hmac_signatures(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", pilot.address_print(F.col("text"), SALT).alias("print"))


@query(
    """SELECT item_id, starts_with(m, 'No encontré nada suficientemente cercano a tu consulta. Busqué en 1.234.567 fragmentos de 7 fuentes oficiales.') AS scope, contains(m, 'dos huecos conocidos') AS coverage
    FROM (SELECT item_id, 'No encontré nada suficientemente cercano a tu consulta. Busqué en 1.234.567 fragmentos de 7 fuentes oficiales. dos huecos conocidos' AS m FROM benchmark)"""
)
def abstention_messages(spark, d):
    m = F.lit(routing.abstention_message(1_234_567))
    start = "No encontré nada suficientemente cercano a tu consulta. Busqué en 1.234.567 fragmentos de 7 fuentes oficiales."
    return table(spark, d, "benchmark").select("item_id", F.startswith(m, F.lit(start)).alias("scope"), F.contains(m, F.lit("dos huecos conocidos")).alias("coverage"))


# --- fragments ------------------------------------------------------------------


@query(
    """WITH a AS (SELECT item_id, text FROM benchmark)
    SELECT item_id AS document_id, item_id || '::frag' || k AS fragment_id, k::BIGINT AS ord, 'ARTÍCULO ' || (k + 1) || 'º. ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text
    FROM a, (SELECT unnest([0, 1, 2]) AS k) WHERE k <= item_id % 3"""
)
def article_fragments(spark, d):
    """Up to three articles of a text each, then a closing formula that goes."""
    i, t = F.col("item_id"), tx.strip(F.col("text"))
    part = lambda k: F.when(i % 3 >= k, F.concat(F.lit(f"ARTÍCULO {k + 1}º. "), t))
    body = F.concat(F.concat_ws("\n", part(0), part(1), part(2)), F.lit("\nCOMUNÍQUESE Y CÚMPLASE."))
    rows = table(spark, d, "benchmark").select(i.alias("id"), body.alias("text"))
    out = chunking.fragments(rows)
    return out.select("document_id", "fragment_id", F.col("ord").cast("long").alias("ord"), chunking.text_to_encode(F.lit(""), F.col("text")).alias("text"))


@query(
    """WITH s AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
    SELECT doc_id, count(*) AS n, sum(length(f))::BIGINT AS n_chars FROM (SELECT doc_id, unnest(CASE WHEN length(t) <= 1500 THEN [t] ELSE list_transform(range(0, ceil((length(t) - 200) / 1300.0)::BIGINT),
        lambda i: regexp_replace(substr(t, (i * 1300 + 1)::BIGINT, 1500), '^\\s+|\\s+$', '', 'g')) END) AS f FROM s) WHERE f <> '' GROUP BY doc_id"""
)
def lateral_fragments(spark, d):
    """Fragments by the table function, joined laterally in SQL; the documents have no articles and no blank lines."""
    tables.register(spark)
    out = spark.sql("SELECT doc_id, f.fragment FROM {docs} d, LATERAL fragments(d.text) f", docs=docs(spark, d).select("doc_id", "text"))
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("fragment")).alias("n_chars"))


@query("SELECT item_id, item_id % 2 = 0 AS only FROM benchmark")
def ceremonial_pieces(spark, d):
    said = F.when(F.col("item_id") % 2 == 0, " COMUNÍQUESE Y CÚMPLASE\nEl Presidente de la República").otherwise("Comuníquese el resultado.\nArtículo uno")
    return table(spark, d, "benchmark").select("item_id", chunking.only_ceremonial(said).alias("only"))


# --- sources and sinks ----------------------------------------------------------


def written(rows, spark, name):
    """One text column as files in the shared folder."""
    path = shared_path(spark, name)
    rows.write.text(path)
    return path


@query(
    """SELECT 'corte_constitucional:C-' || conv_id || '/' || turn AS id, 'C-' || conv_id || '/' || turn AS identificador, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS texto FROM conversations
    WHERE conv_id % 3 > 0 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') NOT IN ('', 'sin información')"""
)
def court_hits(spark, d):
    c = table(spark, d, "conversations")
    text = F.when(F.col("conv_id") % 3 == 0, " Sin información ").otherwise(F.col("text"))
    source = F.struct(F.concat(F.lit("C-"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("prov_sentencia"), text.alias("prov_sintesis"), F.lit("2001-01-01").alias("prov_f_sentencia"), F.lit("t").alias("prov_tema"))
    hit = F.struct(F.col("conv_id").cast("string").alias("_id"), source.alias("_source"))
    answer = F.struct(F.struct(F.struct(F.flatten(F.collect_list(F.array("hit", "hit"))).alias("hits")).alias("hits")).alias("data"))
    path = shared_path(spark, "court")
    # an answer, and so a file, has the hits of up to 1,000 rows of a partition: the driver lists every file
    hits = c.select(hit.alias("hit"), (F.monotonically_increasing_id() / 1000).cast("long").alias("page"))
    hits.groupBy("page").agg(F.to_json(answer).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return connectors.court_hits(spark, path).select("id", "identificador", "texto")


@query(
    """SELECT 'supersociedades:' || item_id AS id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS texto, 'a,b' AS descriptores FROM benchmark
    WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100"""
)
def superintendence_hits(spark, d):
    names = F.array(F.struct(F.lit("a").alias("nombre")), F.struct(F.lit(None).cast("string").alias("nombre")), F.struct(F.lit("b").alias("nombre")))
    source = F.struct(F.struct(F.col("text").alias("contenido_archivo")).alias("documento_principal"), names.alias("descriptores"), F.lit("2001-01-01").alias("fecha"), F.lit("t").alias("titulo"))
    hit = F.struct(F.col("item_id").cast("string").alias("_id"), source.alias("_source"))
    path = shared_path(spark, "super")
    rows = table(spark, d, "benchmark").select(F.to_json(F.struct(F.struct(F.array(hit).alias("hits")).alias("hits"))).alias("value"))
    rows.repartitionByRange(50, "value").write.option("maxRecordsPerFile", 1).text(path)
    return connectors.superintendence_hits(spark, path).select("id", "texto", F.array_join("descriptores", ",").alias("descriptores"))


@query(
    """SELECT 'sic:h' || item_id AS id, CASE WHEN item_id % 3 = 0 THEN 'h' || item_id ELSE '2020-' || item_id END AS identificador, 'SIC ' || CASE WHEN item_id % 2 = 0 THEN 'Auto' ELSE 'Providencia' END || ' ' ||
        CASE WHEN item_id % 3 = 0 THEN 'h' || item_id ELSE '2020-' || item_id END AS titulo, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS texto FROM benchmark
    WHERE item_id % 7 > 0 AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100"""
)
def commerce_hits(spark, d):
    i = F.col("item_id")
    file = F.concat(F.lit("s3/"), i.cast("string"))
    info = F.struct(
        F.when(i % 3 > 0, i.cast("string")).alias("numero_expediente"), F.lit("2020").alias("ano_expediente"), F.when(i % 2 == 0, "Auto").alias("tipo_providencia")
    )
    source = F.struct(info.alias("informacion"), F.struct(F.when(i % 7 > 0, file).alias("url_documento_pdf_s3")).alias("documento_resumen"))
    hit = F.struct(F.concat(F.lit("h"), i.cast("string")).alias("_id"), source.alias("_source"))
    path = shared_path(spark, "commerce")
    table(spark, d, "benchmark").select(F.to_json(F.struct(F.struct(F.array(hit).alias("hits")).alias("hits"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    texts = table(spark, d, "benchmark").select(file.alias("file"), F.col("text").alias("texto"))
    return connectors.commerce_hits(spark, path, texts).select("id", "identificador", "titulo", "texto")


@query("SELECT doc_id, lang FROM documents")
def guarded_index(spark, d):
    """An index of half of the rows, extended under its contract; other settings and a smaller corpus are refused."""
    path, rows, settings = shared_path(spark, "guarded"), docs(spark, d).select("doc_id", "lang"), {"chunk_mode": "paragraphs", "header": "no"}
    rows.filter("doc_id % 2 = 0").write.parquet(f"{path}/rows")
    corpus.write_manifest(spark, f"{path}/manifest", settings)
    for bad in ((rows, {**settings, "header": "yes"}), (rows.filter("doc_id % 2 = 1"), settings)):
        try:
            corpus.guarded_append(bad[0], path, "doc_id", bad[1])
        except ValueError:
            continue
        raise AssertionError("an index was extended against its contract")
    corpus.guarded_append(rows, path, "doc_id", settings)
    return spark.read.parquet(f"{path}/rows")


PROBES = f"q AS (SELECT doc_id AS query_id, unnest({qterms('substr(text, 1, 2000)')}) AS term FROM (SELECT * FROM documents WHERE length(text) > 200 ORDER BY md5('probe|' || doc_id), doc_id LIMIT 50))"


@query(
    bm25_sql(PROBES)
    + """, nv AS (SELECT count(*) AS n FROM documents WHERE length(text) > 0), o AS (SELECT count(*) AS f FROM ranked WHERE rank <= 5 AND query_id = doc_id),
    np AS (SELECT count(*) AS k FROM (SELECT 1 FROM documents WHERE length(text) > 200 LIMIT 50)), nl AS (SELECT count(DISTINCT doc_id) AS m FROM t)
    SELECT nv.n AS n_vectors, m AS n_lexical, abs(nv.n - m) <= 0.01 * nv.n AS agree, np.k AS n_probes, f AS n_found FROM nv, o, np, nl"""
)
def reindex_checks(spark, d):
    """Counts of both halves of an index of the documents, and how many of fifty fragments are found by their own texts."""
    path = shared_path(spark, "reindexed")
    rows = docs(spark, d).select("doc_id", "text")
    lexical.write_index(rows, path)
    vectors = rows.filter(F.length("text") > 0).select("doc_id", F.array(F.length("text").cast("double")).alias("v"))
    vectors.write.parquet(f"{path}/vectors")
    probes = corpus.probe_fragments(rows, 50)
    hits = lexical.bm25_index(spark, path, lexical.query_table(probes, "query_id", "text"), 5)
    return corpus.reindex_checks(spark.read.parquet(f"{path}/vectors"), lexical.indexed_documents(spark, path), probes, hits)


@query(
    """SELECT 'legalize_co_github:L-' || item_id AS id, CASE item_id % 3 WHEN 0 THEN 'ley' WHEN 1 THEN 'decreto' ELSE 'ley' END AS tipo, 'L-' || item_id AS identificador, 'Norma ' || item_id AS titulo,
        regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS texto FROM benchmark WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 40"""
)
def markdown_laws(spark, d):
    i = F.col("item_id").cast("string")
    rank = F.when(F.col("item_id") % 3 == 0, "ley").when(F.col("item_id") % 3 == 1, "Decreto").otherwise("acto_legislativo")
    head = F.concat(F.lit('---\nidentifier: "L-'), i, F.lit('"\nrank: '), rank, F.lit("\ntitle: 'Norma "), i, F.lit("'\n---\n"), F.col("text"))
    path = shared_path(spark, "laws")
    table(spark, d, "benchmark").select(head.alias("value")).repartitionByRange(50, "value").write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return connectors.markdown_laws(spark, path).select("id", "tipo", "identificador", "titulo", "texto")


@query("SELECT page_id AS src, page_id::VARCHAR AS dst, ['Modificado por', 'Deroga', 'relacionado'][(page_id % 3)::INT + 1] AS tipo FROM pages")
def relation_edges(spark, d):
    i = F.col("page_id")
    label = F.when(i % 3 == 0, "Modificado por la Ley 1").when(i % 3 == 1, "Deroga el Decreto 2").otherwise("Ver también")
    link = lambda href, t: F.struct(href.alias("href"), t.alias("label"))
    links = F.array(link(F.concat(F.lit("norma.php?x=1&i="), i.cast("string")), label), link(F.lit("otra.php"), F.lit("Deroga")))
    return connectors.relation_edges(table(spark, d, "pages").select(i.alias("id"), links.alias("enlaces")))


@query("SELECT DISTINCT 'docs/' || lang || '.htm' AS link FROM documents")
def catalogue_links(spark, d):
    html = F.concat(F.lit('<a href="docs/'), "lang", F.lit('.htm">x</a> <a href="docs/'), "lang", F.lit('.htm">y</a><a href="otro.htm">'))
    return connectors.catalogue_links(docs(spark, d).select(html.alias("html")))


@query(
    """SELECT item_id, k AS pos, 'T' || k AS titulo, CASE WHEN k = 1 THEN 'resumen corto' ELSE 'completo ' || item_id END AS texto FROM benchmark, (SELECT unnest([1, 2]) AS k)"""
)
def labelled_records(spark, d):
    i = F.col("item_id").cast("string")
    cell = lambda name, v: F.concat(F.lit(f"<tr><td>{name} </td><td class='x'> <b>"), v, F.lit("</b> </td></tr>"))
    rec = lambda k, full: F.concat(F.lit("<hr>"), cell("Título", F.lit(f"T{k}")), cell("Texto", full), cell("Resumen", F.lit("resumen corto" if k == 1 else "r")))
    html = F.concat(F.lit("inicio"), rec(1, F.lit("")), rec(2, F.concat(F.lit("completo "), i)))
    pages = table(spark, d, "benchmark").select("item_id", html.alias("html"))
    out = connectors.labelled_records(pages, "<hr>", {"titulo": "Título", "completo": "Texto", "resumen": "Resumen"}, "completo", "resumen", keep=["item_id"])
    return out.select("item_id", F.col("pos").cast("long").alias("pos"), "titulo", "texto")


def _docx_of(text):
    """A Word document of a text's lines."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{binary.WORD[1:-1]}"><w:body>{lines}</w:body></w:document>')
    return out.getvalue()


def _files(spark, d):
    """(path, content): for each document a Word, a text or a Latin-1 file, of every third one a second file of its stem."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B-\x1F]", "")
    rows = docs(spark, d).select("doc_id", clean.alias("t"))

    @F.pandas_udf("binary")
    def word(t: pd.Series) -> pd.Series:
        return t.map(_docx_of)

    i, stem = F.col("doc_id") % 4, F.concat(F.lit("s/f"), F.col("doc_id").cast("string"))
    latin = F.when(F.col("t").rlike(r"^[\x{00}-\x{FF}]*$"), F.encode("t", "ISO-8859-1")).otherwise(F.encode("t", "UTF-8"))
    content = F.when(i == 0, word("t")).when(i == 1, F.encode("t", "UTF-8")).when(i == 2, latin).otherwise(F.concat(F.unhex(F.lit("25504446")), F.encode("t", "UTF-8")))
    ends = F.when(i == 0, ".docx").when(i == 3, ".pdf").otherwise(".txt")
    first = rows.select(F.concat(stem, ends).alias("path"), content.alias("content"))
    second = rows.filter("doc_id % 3 = 0").select(F.concat(stem, F.lit(".bin")).alias("path"), F.encode(F.concat(F.lit("second "), "t"), "UTF-8").alias("content"))
    return first.unionByName(second)


FILES_SQL = r"""c AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F]', '', 'g') AS t FROM documents),
    p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN array_to_string(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> ''), chr(10)) WHEN doc_id % 4 < 3 THEN t END AS t,
        ['.docx', '.txt', '.txt', '.pdf'][doc_id % 4 + 1] AS e, ['zip', 'text', 'text', 'pdf'][doc_id % 4 + 1] AS kind FROM c),
    f AS (SELECT doc_id, t, e, kind FROM p UNION ALL SELECT doc_id, 'second ' || t, '.bin', 'text' FROM c WHERE doc_id % 3 = 0)"""


@query(f"WITH {FILES_SQL} SELECT 's/f' || doc_id || e AS path, CASE WHEN kind = 'text' AND length(t) = 0 THEN 'unknown' ELSE kind END AS kind FROM f")
def binary_kinds(spark, d):
    return _files(spark, d).select("path", connectors.binary_kind(F.col("content")).alias("kind"))


@query(
    f"""WITH {FILES_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE e WHEN '.docx' THEN 1 WHEN '.txt' THEN 2 WHEN '.pdf' THEN 3 ELSE 4 END) AS k
        FROM f WHERE t IS NOT NULL AND length(t) BETWEEN 1 AND 2000000)
    SELECT 's/f' || doc_id AS stem, 's/f' || doc_id || e AS path, kind, md5(t) AS h FROM g WHERE k = 1"""
)
def binary_texts(spark, d):
    """The texts of Word, text and Latin-1 files, one of each stem."""
    return binary.documents_of(_files(spark, d)).select("stem", "path", "kind", F.md5("texto").alias("h"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'SC' || (100 + item_id) || '-2020' ELSE 'archivo' END AS ident FROM benchmark")
def title_identifiers(spark, d):
    title = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Sentencia SC"), (100 + F.col("item_id")).cast("string"), F.lit("-2020 (x)"))).otherwise("Auto sin número")
    return table(spark, d, "benchmark").select("item_id", connectors.title_identifier(title, F.lit("archivo")).alias("ident"))


TURNS = "t AS (SELECT conv_id * 1000 + turn AS n, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM conversations)"


@query(
    f"""WITH {TURNS}, u AS (SELECT n, w FROM t WHERE len(w) >= 12),
    s AS (SELECT w[1] AS asked, n AS pos, array_to_string(w[1:8], ' ') AS suggestion FROM u
        UNION ALL SELECT 'puedo ' || w[1], n, array_to_string(w[2:9], ' ') FROM u UNION ALL SELECT array_to_string(w[1:8], ' '), n, array_to_string(w[3:12], ' ') FROM u),
    seeds AS (SELECT seed, row_number() OVER (ORDER BY seed) AS pos FROM (SELECT DISTINCT w[1] AS seed FROM u)),
    r AS (SELECT *, row_number() OVER (ORDER BY pos, k, seed) AS request FROM (SELECT seed, pos, unnest([0, 1]) AS k FROM seeds)),
    a AS (SELECT *, CASE WHEN k = 0 THEN seed ELSE 'puedo ' || seed END AS asked FROM r WHERE request <= 300),
    f AS (SELECT suggestion AS query, a.seed, request, s.pos FROM a JOIN s USING (asked) WHERE NOT regexp_matches(suggestion, '^the |junk')),
    z AS (SELECT query, arg_min(seed, (request, pos, seed)) AS seed, min((request, pos)) AS m FROM f GROUP BY query),
    h AS (SELECT query AS asked, seed, row_number() OVER (ORDER BY m, query) AS request FROM z QUALIFY request <= least(120, 300 - (SELECT count(*) FROM a))),
    g AS (SELECT suggestion AS query, h.seed, request, s.pos FROM h JOIN s USING (asked) WHERE NOT regexp_matches(suggestion, '^the |junk')),
    y AS (SELECT query, arg_min(seed, (request, pos, seed)) AS seed FROM g WHERE query NOT IN (SELECT query FROM z) GROUP BY query)
    SELECT query, seed, 0 AS level FROM z UNION ALL SELECT query, seed, 1 FROM y"""
)
def harvested_queries(spark, d):
    """Two levels of suggestions; what is suggested for a text are the turns that begin like it."""
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda x: x != "")
    u = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), w.alias("w")).filter(F.size("w") >= 12)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    asked = ((F.col("w")[0], part(1, 8)), (F.concat(F.lit("puedo "), F.col("w")[0]), part(2, 8)), (part(1, 8), part(3, 10)))
    rows = u.select("pos", F.explode(F.array(*(F.struct(a.alias("asked"), b.alias("suggestion")) for a, b in asked))).alias("x")).select("pos", "x.*")
    seeds = numbered(u.select(F.col("w")[0].alias("seed")).distinct(), ["seed"], "pos")
    return connectors.harvested(rows, seeds, ("puedo",), "^the |junk", requests=300)


@query("SELECT event_id, event_type FROM events")
def appended_pending(spark, d):
    """A table that had a third of the rows, brought up to date twice."""
    path, rows = shared_path(spark, "pending"), table(spark, d, "events").select("event_id", "event_type")
    rows.filter("event_id % 3 = 0").write.parquet(path)
    connectors.append_pending(rows, path, "event_id")
    connectors.append_pending(rows, path, "event_id")
    return spark.read.parquet(path)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE lang END AS lang FROM documents")
def upserted_rows(spark, d):
    old = docs(spark, d).select("doc_id", "lang")
    return corpus.upsert(old, old.filter("doc_id % 2 = 0").withColumn("lang", F.lit("new")), "doc_id")


@query("SELECT source, count(*) AS n FROM documents WHERE source = 'src1' GROUP BY 1")
def collection_by_source(spark, d):
    path = shared_path(spark, "collection")
    connectors.write_collection(docs(spark, d), path, "source")
    return spark.read.parquet(path).filter("source = 'src1'").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT vec_id AS doc_id, lang FROM embeddings JOIN documents ON vec_id = doc_id")
def imported_vectors(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"), "embedding")
    return connectors.imported_vectors(vectors, docs(spark, d).select("doc_id", "lang"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id AS id, md5(text) AS h FROM documents")
def corpus_json_round_trip(spark, d):
    """The corpus written as JSON sheets and read by the corpus reader."""
    path = shared_path(spark, "sheets")
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.lit("x").alias("fuente"), F.col("text").alias("texto"))
    connectors.write_json(rows, path)
    out = spark.read.schema(connectors.DOCUMENT).json(path)
    return out.select(F.col("id").cast("long").alias("id"), F.md5("texto").alias("h"))


@query("SELECT event_id, user_id FROM events")
def ingested_stream(spark, d):
    """The events as a stream into a table, drained twice: a second run adds nothing."""
    base = shared_path(spark, "ingest")
    schema = table(spark, d, "events").schema
    for k in (0, 1):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{d}/").select("event_id", "user_id")
        quota.ingest(stream, f"{base}/table", "event_id", f"{base}/checkpoint{k}")
    return spark.read.parquet(f"{base}/table")


@query(
    "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events "
    "WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL"
)
def streamed_counts(spark, d):
    """Tumbling windows that the watermark has closed."""
    base = shared_path(spark, "counts")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{d}/")
    out = quota.run_once(quota.tumbling_counts(stream), spark, f"{base}/out", f"{base}/checkpoint")
    return staged(out.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("value", 6).alias("value")), "counts")
