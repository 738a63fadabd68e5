"""Registered queries of what serves users and of question banks, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions import text as tx
from corvina.operators import banks, chunking, corpus, evaluate, fusion, grounding, lexical, pilot, routing, serving, usage, validity, vector
from corvina.plans import search
from corvina.plans.register import BENCH_Q, L2, bench_terms, bm25_sql, docs, query, toks
from corvina.session import table
from corvina.shared import shared_path
from corvina.sources import connectors

# --- requests and lookups -----------------------------------------------------

def note(state, scope, text, by=None):
    """A column of the struct that validity.annotate() gives."""
    values = [x if not isinstance(x, str) and x is not None else F.lit(x).cast("string") for x in (state, scope, text, by)]
    return F.struct(*(v.alias(n) for v, n in zip(values, ("estado", "alcance", "texto", "por"))))


@query(
    """SELECT event_id, substr(trim(t), 1, 1000) AS consulta, least(greatest(coalesce(nullif(n, 0), 5), 1), 20)::INT AS k, trim(t) = '' AS empty
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '  ' ELSE ' ' || repeat(event_type || ' ', 1 + (event_id % 200)::INT) END AS t,
        CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN event_id % 50 WHEN 2 THEN -3 ELSE 0 END AS n FROM events)"""
)
def tool_requests(spark, d):
    i = F.col("event_id")
    t = F.when(i % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.expr("repeat(concat(event_type, ' '), cast(1 + event_id % 200 as int))")))
    n = F.when(i % 4 == 0, F.when(i % 8 == 0, "many")).when(i % 4 == 1, (i % 50).cast("string")).when(i % 4 == 2, "-3").otherwise("0")
    rows = table(spark, d, "events").select("event_id", t.alias("t"), n.alias("n"))
    return serving.tool_requests(rows, "t", "n").select("event_id", "consulta", "k", "empty")


BODIES = (
    '{"consulta": "plazo"}', '{"consulta": "plazo", "n": 3}', '{"consulta": "plazo", "n": 400, "fuentes": ["dian", "x"]}', '{"consulta": " "}',
    '{"consulta": 5}', '{"consulta": "plazo", "n": 0}', '{"consulta": "plazo", "n": true}', '{"consulta": "plazo", "n": 2.5}', "[1]", "no json",
    '{"consulta": "plazo", "fuentes": "dian"}', '{"consulta": "plazo", "fuentes": ["x"]}', '{"consulta": "plazo", "fuentes": [1]}', '{"n": 2}',
)
_BODY_SQL = ", ".join(f"'{b}'" for b in BODIES)


@query(
    f"""WITH r AS (SELECT event_id, ([{_BODY_SQL}])[(event_id % {len(BODIES)})::INT + 1] AS body FROM events),
    j AS (SELECT event_id, body, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM r),
    t AS (SELECT *, json_type(v) AS kind, json_type(v, '$.consulta') AS ck, json_type(v, '$.n') AS nk, json_type(v, '$.fuentes') AS fk,
        json_extract_string(v, '$.consulta') AS c, json_extract(v, '$.fuentes')::VARCHAR AS f FROM j),
    e AS (SELECT *, CASE WHEN NOT ok THEN 'El cuerpo no es JSON válido.' WHEN kind <> 'OBJECT' THEN 'El cuerpo debe ser un objeto JSON.'
        WHEN coalesce(ck, '') <> 'VARCHAR' OR trim(c) = '' THEN 'Falta el campo ''consulta'' (texto no vacío).'
        WHEN nk IS NOT NULL AND (nk NOT IN ('UBIGINT', 'BIGINT') OR json_extract_string(v, '$.n')::DOUBLE < 1) THEN 'El campo ''n'' debe ser un entero mayor o igual a 1.'
        WHEN fk IS NOT NULL AND (fk <> 'ARRAY' OR regexp_matches(f, '[\\[,][0-9]')) THEN 'El campo ''fuentes'' debe ser una lista de textos.' END AS error FROM t)
    SELECT event_id, CASE WHEN error IS NULL THEN 200 ELSE 400 END::INT AS status, error, CASE WHEN error IS NULL THEN c END AS consulta,
        CASE WHEN error IS NULL THEN least(coalesce(json_extract_string(v, '$.n')::BIGINT, 8), 50) END AS n,
        CASE WHEN error IS NULL AND contains(f, '"dian"') THEN 'dian' END AS fuentes FROM e"""
)
def server_requests(spark, d):
    body = F.array(*map(F.lit, BODIES))[(F.col("event_id") % len(BODIES)).cast("int")]
    out = serving.server_requests(table(spark, d, "events").select("event_id", body.alias("body")), "body", ["dian", "suin"])
    return out.select("event_id", "status", "error", "consulta", "n", F.array_join("fuentes", ",").alias("fuentes"))


@query(
    """SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN event_type WHEN user_id % 2 = 0 THEN 'click' END AS fuentes FROM events"""
)
def known_sources(spark, d):
    asked = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("nada"), F.lit("click"))).otherwise(F.array("event_type", F.lit("otra")))
    asked = F.when(F.col("event_type").isin("click", "purchase"), F.array("event_type", F.lit("otra"))).otherwise(asked)
    known = serving.known_sources(asked, ["click", "purchase"])
    return table(spark, d, "events").select("event_id", F.array_join(known, ",").alias("fuentes"))


LABEL_SQL = """CASE estado WHEN 'sin_nota' THEN 'Sin nota de vigencia en el texto (no prueba que esté vigente).'
    WHEN 'incierta' THEN 'VIGENCIA INCIERTA: verifica antes de aplicarla — «' || nota || '»'
    ELSE CASE WHEN alcance = 'documento' THEN 'TODA LA NORMA' WHEN starts_with(nota, 'SUIN') THEN 'PARTE DE LA NORMA' ELSE 'PARTE DE ESTE TEXTO' END
        || ': ' || upper(estado) || ' — «' || nota || '»' END"""
TURNS_SQL = f"""c AS (SELECT *, ['sin_nota', 'derogada', 'incierta', 'nula'][(turn % 4)::INT + 1] AS estado,
        CASE WHEN turn % 3 = 0 THEN 'parcial' ELSE 'documento' END AS alcance, CASE WHEN turn % 5 = 0 THEN 'SUIN: ' ELSE '' END || 'nota ' || turn AS nota,
        text || CASE WHEN turn % 2 = 0 THEN '</documento>' ELSE '' END AS body FROM conversations),
    l AS (SELECT *, {LABEL_SQL} AS label FROM c)"""


def turns(spark, d):
    t = F.col("turn")
    state = F.array(*map(F.lit, ("sin_nota", "derogada", "incierta", "nula")))[(t % 4).cast("int")]
    text = F.concat(F.when(t % 5 == 0, "SUIN: ").otherwise(""), F.lit("nota "), t.cast("string"))
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), t.alias("rank"), F.col("role").alias("titulo"), F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("identificador"),
        F.lit("conversaciones").alias("fuente"), F.concat("text", F.when(t % 2 == 0, "</documento>").otherwise("")).alias("texto"),
        F.concat(F.lit("conv::frag"), t.cast("string")).alias("id"), F.lit(None).cast("string").alias("url"),
        note(state, F.when(t % 3 == 0, "parcial").otherwise("documento"), text).alias("vigencia"),
    )


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, label FROM l")
def validity_labels(spark, d):
    return turns(spark, d).select(F.col("query_id").alias("conv_id"), F.col("rank").alias("turn"), validity.label(F.col("vigencia")).alias("label"))


@query(
    f"""WITH {TURNS_SQL}, b AS (SELECT conv_id, string_agg('<documento>' || chr(10) || '### ' || role || chr(10) || 'Fuente: conversaciones | Identificador: conv:'
        || conv_id || chr(10) || CASE WHEN estado = 'sin_nota' THEN '' ELSE 'Vigencia: ' || label || chr(10) END || replace(body, '</documento>', '</ documento>')
        || chr(10) || '</documento>', chr(10) ORDER BY turn) AS blocks FROM l GROUP BY conv_id)
    SELECT item_id AS query_id, md5('Reglas' || chr(10) || chr(10) || 'Fragmentos disponibles:' || chr(10) || chr(10) || coalesce(blocks, '') || chr(10) || chr(10)
        || 'Pregunta: ' || text || chr(10) || chr(10) || 'Respuesta:') AS prompt FROM benchmark LEFT JOIN b ON conv_id = item_id"""
)
def prompts_built(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return serving.prompts(asked, turns(spark, d), "Reglas").select("query_id", F.md5("prompt").alias("prompt"))


@query(
    f"""WITH {TURNS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM l),
    b AS (SELECT conv_id, string_agg('### ' || role || chr(10) || 'Fuente: conversaciones | Identificador: conv:' || conv_id || ' | Fragmento: conv::frag' || turn
        || chr(10) || 'URL: None' || chr(10) || 'Vigencia: ' || label || chr(10) || '<fragmento>' || chr(10) || body || chr(10) || '</fragmento>' || chr(10),
        chr(10) || '---' || chr(10) ORDER BY turn) AS parts FROM n WHERE rn <= 2 GROUP BY conv_id)
    SELECT item_id AS query_id, md5(CASE WHEN item_id % 7 = 0 THEN 'Consulta vacía.' ELSE coalesce(parts, 'Sin resultados en el índice actual para esta consulta.') END) AS output
    FROM benchmark LEFT JOIN b ON conv_id = item_id"""
)
def tool_outputs(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 7 == 0, " ").otherwise(F.col("text")).alias("t"), F.lit("2").alias("n"))
    out = serving.tool_results(serving.tool_requests(asked, "t", "n"), turns(spark, d))
    return out.select("query_id", F.md5("output").alias("output"))


FRAG_TEXT_SQL = "CASE WHEN doc_id % 5 = 0 THEN '<Ley INEXEQUIBLE> ' ELSE '' END || text"


def id_fragments(spark, d):
    """documents as fragments with string ids, one in five of a norm that no longer holds."""
    i = F.col("doc_id")
    return docs(spark, d).select(
        F.concat("source", F.lit(":doc_"), i.cast("string"), F.lit("::frag0")).alias("id"), F.concat(F.lit("Doc "), i.cast("string")).alias("titulo"),
        F.lit("http://x").alias("url"), F.concat(F.when(i % 5 == 0, "<Ley INEXEQUIBLE> ").otherwise(""), "text").alias("texto"), "source", i.alias("doc_id"),
    )


@query(
    f"""WITH f AS (SELECT doc_id, source || ':doc_' || doc_id || '::frag0' AS id, {FRAG_TEXT_SQL} AS texto FROM documents),
    r AS (SELECT vec_id AS request_id, CASE WHEN vec_id % 6 = 1 THEN 'no ; id::x' WHEN vec_id % 6 = 2 THEN 'x::frag9' ELSE coalesce(' ' || id, 'none::frag0') END AS fragment_id
        FROM embeddings LEFT JOIN f ON vec_id = doc_id)
    SELECT request_id, md5(CASE WHEN request_id % 6 = 1 THEN 'Identificador de fragmento inválido.' WHEN id IS NULL THEN 'No existe ese fragmento en el índice.'
        ELSE '### Doc ' || doc_id || chr(10) || 'URL: http://x' || chr(10) || 'Vigencia: ' || CASE WHEN doc_id % 5 = 0 THEN 'TODA LA NORMA: INEXEQUIBLE — «Ley INEXEQUIBLE»'
        ELSE 'Sin nota de vigencia en el texto (no prueba que esté vigente).' END || chr(10) || '<fragmento>' || chr(10) || texto || chr(10) || '</fragmento>' END) AS output
    FROM r LEFT JOIN f ON id = trim(fragment_id)"""
)
def read_fragments(spark, d):
    f = id_fragments(spark, d)
    i = F.col("vec_id")
    asked = table(spark, d, "embeddings").select("vec_id").join(f.select("doc_id", "id"), i == F.col("doc_id"), "left").select(
        i.alias("request_id"),
        F.when(i % 6 == 1, "no ; id::x").when(i % 6 == 2, "x::frag9").otherwise(F.coalesce(F.concat(F.lit(" "), "id"), F.lit("none::frag0"))).alias("fragment_id"),
    )
    out = serving.read_fragments(asked, f, validity.validity_table(f))
    return out.select("request_id", F.md5("output").alias("output"))


@query(
    """SELECT vec_id AS request_id, CASE WHEN vec_id % 6 = 1 THEN 'Identificador inválido.' WHEN doc_id % 5 = 0 THEN source || ':doc_' || vec_id || '::frag3: INEXEQUIBLE. Nota oficial: «Ley INEXEQUIBLE».'
        ELSE coalesce(source, 'none') || ':doc_' || vec_id || '::frag3: sin nota de vigencia de alcance documental en el índice. No prueba que esté vigente; verifica en SUIN-Juriscol o en la fuente oficial.' END AS output
    FROM embeddings LEFT JOIN documents ON vec_id = doc_id"""
)
def validity_answers(spark, d):
    f, i = id_fragments(spark, d), F.col("vec_id")
    known = docs(spark, d).select("doc_id", "source")
    asked = table(spark, d, "embeddings").select("vec_id").join(known, i == F.col("doc_id"), "left").select(
        i.alias("request_id"),
        F.when(i % 6 == 1, "no id!").otherwise(F.concat(F.coalesce("source", F.lit("none")), F.lit(":doc_"), i.cast("string"), F.lit("::frag3"))).alias("document_id"),
    )
    return serving.validity_answers(asked, validity.validity_table(f))


@query("SELECT doc_id, source, md5(text) AS h FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def point_lookup(spark, d):
    wanted = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"))
    return serving.by_id(docs(spark, d), wanted, "doc_id").select("doc_id", "source", F.md5("text").alias("h"))


@query(
    "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS h FROM pages"
)
def html_escaped(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(serving.escaped(F.col("html"))).alias("h"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS nota, CASE WHEN doc_id % 3 = 0 THEN lang END AS motivo FROM documents"""
)
def json_blocks(spark, d):
    i = F.col("doc_id")
    good = F.concat(F.lit('Claro:\n{"nota": '), i.cast("string"), F.lit(', "motivo": "'), "lang", F.lit('"}\nfin'))
    said = F.when(i % 3 == 0, good).when(i % 3 == 1, "sin objeto").otherwise('{"nota": ')
    block = serving.json_block(said, "nota long, motivo string")
    return docs(spark, d).select("doc_id", block["nota"].alias("nota"), block["motivo"].alias("motivo"))


@query("SELECT item_id, 'query: ' || text AS q, 'passage: ' || text AS p, text AS plain FROM benchmark")
def prefixed_texts(spark, d):
    t, p = F.col("text"), serving.prefixed
    return table(spark, d, "benchmark").select(
        "item_id", p(t, "intfloat/multilingual-E5-base", "query").alias("q"), p(t, "/a/model", "passage", "e5").alias("p"), p(t, "e5", "query", "ninguno").alias("plain")
    )


@query(
    "SELECT conv_id, turn, substr(text, 1, 200) AS short, md5(substr(text, 1, 4000)) AS long FROM conversations "
    "WHERE len(regexp_extract_all(trim(text), '\\S+')) >= 4 AND NOT regexp_matches(text, '(?i)\\b(meme|memes|cancion|letra|pelicula|serie|novela|frases?|chistes?|como se escribe|"
    "en ingles|significado biblico|sue[nñ]o|suenos?|youtube|tiktok|facebook|whatsapp|instagram)\\b')"
)
def useful_queries(spark, d):
    c = table(spark, d, "conversations").filter(serving.useful_query(F.col("text")))
    return c.select("conv_id", "turn", serving.snippet(F.col("text"), 200).alias("short"), F.md5(serving.snippet(F.col("text"), 4000)).alias("long"))


# --- plug-ins -----------------------------------------------------------------


def _letters():
    return lambda texts: [[float(len(t)), float(t.count("a")), float(t.count("e"))] for t in texts]


def _echo():
    def complete(prompt):
        if len(prompt) % 5 == 0:
            raise ValueError("no answer")
        return prompt[:10]

    return complete


@query("SELECT item_id, length(text)::DOUBLE AS n, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS a FROM benchmark")
def encoded_texts(spark, d):
    out = serving.encoded(table(spark, d, "benchmark").select("item_id", "text"), "text", _letters)
    return out.select("item_id", F.col("embedding")[0].alias("n"), F.col("embedding")[1].alias("a"))


@query(
    "SELECT item_id, CASE WHEN length(text) % 5 > 0 THEN substr(text, 1, 10) END AS respuesta, CASE WHEN length(text) % 5 = 0 THEN 'ValueError: no answer' END AS error FROM benchmark"
)
def completed_prompts(spark, d):
    out = serving.completed(table(spark, d, "benchmark").select("item_id", "text"), "text", _echo)
    serving.stop_if_all_fail(out, "item_id", "error", 5)
    return out.select("item_id", "respuesta", "error")


# --- plans, prices ------------------------------------------------------------


@query(
    """WITH p(plan, tope, periodo, dias) AS (VALUES ('pase-dia', 100, 'dia', 0), ('mensual', 100, 'mes', 31), ('pro', NULL, 'mes', 31), ('gold', NULL, 'dia', 1147))
    SELECT o_orderkey, tope::BIGINT AS tope, periodo, (o_orderdate + CAST(dias AS INT) * INTERVAL 1 DAY)::DATE AS vence,
        date_diff('day', DATE '2026-09-06', o_orderdate::DATE) / 30.44 > 3 AS stale
    FROM orders LEFT JOIN p ON plan = ['pase-dia', 'mensual', 'pro', 'gold', 'none'][(o_orderkey % 5)::INT + 1]"""
)
def issued_plans(spark, d):
    plan = F.array(*map(F.lit, ("pase-dia", "mensual", "pro", "gold", "none")))[(F.col("o_orderkey") % 5).cast("int")]
    out = usage.issued_plans(table(spark, d, "orders").withColumn("plan", plan), "plan", "o_orderdate")
    return out.select("o_orderkey", "tope", "periodo", "vence", usage.prices_stale(F.col("o_orderdate")).alias("stale"))


@query(
    """SELECT event_id, CASE user_id % 4 WHEN 3 THEN 'unknown' WHEN 2 THEN 'expired' WHEN 1 THEN CASE WHEN rn <= 2 THEN 'ok' ELSE 'over' END
        ELSE CASE WHEN an <= 3 THEN 'anonymous' ELSE 'over' END END AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS rn,
        row_number() OVER (PARTITION BY user_id % 4, user_id % 8, day ORDER BY ts, event_id) AS an
        FROM (SELECT *, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') AS day FROM events))"""
)
def quota_unknown_keys(spark, d):
    u = F.col("user_id")
    e = table(spark, d, "events").select("event_id", "ts", F.when(u % 4 == 0, None).otherwise(u).alias("key"), (u % 8).cast("string").alias("address"), "user_id")
    plans = table(spark, d, "events").select(u.alias("key")).distinct().filter("key % 4 in (1, 2)").select(
        "key", F.lit(2).cast("long").alias("tope"), F.lit("dia").alias("periodo"), F.when(F.col("key") % 4 == 2, F.lit("1990-01-01").cast("date")).alias("vence")
    )
    return usage.plan_verdicts(e, plans, "key", "ts", "event_id", "address", 3).select("event_id", "verdict")


@query(
    """WITH k AS (SELECT strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') AS period, user_id, ts, event_id FROM events),
    f AS (SELECT period, user_id, min(row(ts, event_id)) AS m FROM k GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY m) AS place FROM f)
    SELECT event_id, place <= 4 AS remembered FROM k JOIN p USING (period, user_id)"""
)
def quota_key_cap(spark, d):
    return usage.capped_keys(table(spark, d, "events"), "user_id", "ts", "event_id", 4).select("event_id", "remembered")


@query(
    """SELECT user_id AS key, CASE user_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN -1 END::BIGINT AS tope, CASE WHEN user_id % 4 = 1 THEN 'mes' ELSE 'dia' END AS periodo,
        CASE WHEN user_id % 4 = 0 THEN DATE '2027-01-31' END AS vence, user_id % 4 NOT IN (2, 3) AS valid FROM (SELECT DISTINCT user_id FROM events)"""
)
def parsed_plans(spark, d):
    u = F.col("user_id") % 4
    raw = F.when(u == 0, '{"tope_diario": 5, "vence": "2027-01-31"}').when(u == 1, '{"tope": 7, "periodo": "mes"}').when(u == 2, '{"tope": -1}').otherwise('{"vence": "mañana"}')
    out = usage.parsed_plans(table(spark, d, "events").select(F.col("user_id").alias("key")).distinct().withColumn("user_id", F.col("key")).withColumn("plan", raw))
    return out.select("key", "tope", "periodo", "vence", "valid")


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 2 THEN 0 ELSE user_id END::BIGINT AS tokens_in, CASE event_id % 3 WHEN 2 THEN 0 ELSE 10 END::BIGINT AS tokens_out,
        round(CASE event_id % 3 WHEN 2 THEN 0 ELSE user_id / 1e6 * 2.5 + 10 / 1e6 * 10 END, 12)::DOUBLE AS usd FROM events"""
)
def cost_settled(spark, d):
    i, u, none = F.col("event_id") % 3, F.col("user_id").cast("long"), F.lit(None).cast("long")
    rows = table(spark, d, "events").select(
        "event_id", F.lit("gpt-4o").alias("model"), F.when(i == 0, u).otherwise(none).alias("input_tokens"), F.when(i == 1, u).otherwise(F.lit(0)).alias("prompt_tokens"), none.alias("prompt_token_count"),
        F.when(i == 0, 10).otherwise(none).alias("output_tokens"), F.when(i == 1, 10).otherwise(none).alias("completion_tokens"), none.alias("candidates_token_count"),
    )
    return usage.settled(rows, "model").select("event_id", F.col("tokens_in").cast("long").alias("tokens_in"), F.col("tokens_out").cast("long").alias("tokens_out"), F.round("usd", 12).alias("usd"))


@query("SELECT item_id, sha256('k' || item_id) AS h FROM benchmark")
def key_hashes(spark, d):
    return table(spark, d, "benchmark").select("item_id", usage.key_hash(F.concat(F.lit(" k"), F.col("item_id").cast("string"), F.lit(" "))).alias("h"))


# --- graph, unions, small checks ----------------------------------------------


@query(
    """SELECT count(*) AS n_edges, count(*) FILTER (doc_id * 2 NOT IN (SELECT doc_id FROM documents)) AS n_broken,
        floor(100 * count(*) FILTER (doc_id * 2 NOT IN (SELECT doc_id FROM documents)) / count(*))::BIGINT AS pct_broken FROM documents"""
)
def graph_totals(spark, d):
    edges = docs(spark, d).select(F.col("doc_id").alias("src"), (F.col("doc_id") * 2).alias("dst"))
    return corpus.graph_totals(edges, docs(spark, d).select(F.col("doc_id").alias("id")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1")
def bad_dates(spark, d):
    i = F.col("o_orderkey") % 3
    written = F.when(i == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00")).when(i == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("")
    return corpus.bad_dates(table(spark, d, "orders").select("o_orderkey", written.alias("fecha")), "fecha").select("o_orderkey")


@query("SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def all_sources(spark, d):
    a = docs(spark, d).select(F.col("doc_id").alias("id"), "lang")
    return corpus.all_sources([a, table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")]).select("id", "lang", "url")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def flattened_metadata(spark, d):
    nested = docs(spark, d).select("doc_id", "lang", F.struct(F.lit("?").alias("lang"), "source", "n_chars").alias("metadata"))
    return corpus.flattened(nested, "metadata").select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE length(text) BETWEEN 300 AND 1800 ORDER BY md5('s|' || doc_id), doc_id LIMIT 300)")
def rejection_sample(spark, d):
    return banks.rejection_sample(docs(spark, d), "doc_id", "text", 300, "s").select("doc_id")


# --- banks --------------------------------------------------------------------

CASE_KINDS = ("responde", "responde", "trampa_derogada", "no_cubierto", "no_cubierto", "raro", "responde", "solo_referencia", "responde")


def bank_cases(spark, d):
    i = F.col("doc_id")
    frag = F.concat(F.lit("d"), i.cast("string"), F.lit("::frag0"))
    k = i % 9
    return docs(spark, d).select(
        F.concat(F.lit("c"), F.floor(i / F.when(k == 8, 1).otherwise(1)).cast("string")).alias("case_id"),
        F.array(*map(F.lit, CASE_KINDS))[k.cast("int")].alias("tipo"),
        F.when(k.isin(3, 6), None).when(k == 2, F.concat(F.lit("x"), frag)).otherwise(frag).alias("fragmento_id"),
        F.when(k == 1, F.lit("otro")).when(k.isin(3, 6), None).otherwise(F.concat(F.lit("d"), i.cast("string"))).alias("documento_id"),
        F.when(k == 0, F.substring(F.regexp_replace("text", r"\s+", " "), 3, 20)).when(k == 7, "no está en ninguna parte").when(k == 4, "algo").alias("cita_esperada"),
        "text",
    )


@query(
    """SELECT 'c' || doc_id AS case_id, unnest(CASE doc_id % 9 WHEN 1 THEN ['no_prefix', 'no_citation'] WHEN 2 THEN ['no_prefix', 'anchor_missing']
        WHEN 4 THEN ['anchor_not_allowed', 'citation_not_allowed'] WHEN 5 THEN ['unknown_kind'] WHEN 6 THEN ['no_anchor'] WHEN 7 THEN ['citation_not_literal']
        WHEN 8 THEN ['no_citation'] END) AS problem FROM documents WHERE doc_id % 9 NOT IN (0, 3)"""
)
def bank_violations(spark, d):
    cases = bank_cases(spark, d)
    texts = docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("::frag0")).alias("id"), F.col("text").alias("texto"))
    return banks.bank_violations(cases.drop("text"), texts)


@query(
    """WITH e AS (SELECT DISTINCT lang AS p, source AS s FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY md5('2026|' || s), s) AS rn, count(*) OVER (PARTITION BY p) AS n FROM e),
    f AS (SELECT s, p, CASE WHEN rn <= n // 2 THEN 'dev' ELSE 'test' END AS part FROM o)
    SELECT s AS source, arg_min(part, p) AS part FROM f GROUP BY s"""
)
def split_by_profile(spark, d):
    return banks.split_by_profile(docs(spark, d), "lang", "source")


@query("SELECT lang FROM documents GROUP BY lang HAVING count(DISTINCT doc_id % 2) = 2")
def split_leaks(spark, d):
    side = F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("test")
    return banks.split_leaks(docs(spark, d).withColumn("part", side), "part", "lang")


@query("SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents) WHERE place <= 25")
def first_of_profile(spark, d):
    return banks.first_of_profile(docs(spark, d), "lang", "doc_id", 25).select("doc_id", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, quality AS a, toxic AS b FROM labels")
def paired_runs(spark, d):
    rows = table(spark, d, "labels")
    return banks.paired(rows, rows, "doc_id", "quality").drop("b").join(rows.select("doc_id", F.col("toxic").alias("b")), "doc_id")


@query("SELECT doc_id, quality, lang FROM labels LEFT JOIN documents USING (doc_id)")
def detail_bank_join(spark, d):
    return banks.with_details(table(spark, d, "labels"), docs(spark, d).select("doc_id", "lang"), "doc_id").select("doc_id", "quality", "lang")


@query(
    """WITH s AS (SELECT doc_id % 40 AS k, sum(quality) AS b, sum(toxic) AS o FROM labels GROUP BY 1)
    SELECT count(*) FILTER (o > b) AS better, count(*) FILTER (o < b) AS worse, count(*) AS anchors FROM s"""
)
def anchor_wins(spark, d):
    rows = table(spark, d, "labels").withColumn("k", F.col("doc_id") % 40)
    return banks.anchor_wins(rows.select("k", F.col("quality").alias("hit")), rows.select("k", F.col("toxic").alias("hit")), "k", "hit")


@query(
    """WITH s AS (SELECT doc_id % 60 AS seed, count(*) AS n, sum(toxic)::BIGINT AS covered FROM labels GROUP BY 1 HAVING count(*) >= 3), t AS (SELECT *, round(covered / n, 6) AS share FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY share DESC, seed) <= 10 AS best, row_number() OVER (ORDER BY share, seed DESC) <= 12 AS worst FROM t)
    SELECT seed, n, covered, share, best, worst FROM r WHERE best OR worst"""
)
def coverage_by_seed(spark, d):
    return banks.coverage_by_seed(table(spark, d, "labels").withColumn("s", F.col("doc_id") % 60), "s", "toxic")


SPLIT_LISTS_SQL = """, g AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS document FROM benchmark),
    r AS (SELECT query_id, source AS document, rank FROM ranked JOIN documents USING (doc_id) WHERE rank <= 12),
    m AS (SELECT g.query_id, min(rank) FILTER (rank <= 4) AS v, min(rank - 4) FILTER (rank BETWEEN 5 AND 8) AS l, min(rank) FILTER (rank <= 2) AS f
        FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.document = g.document GROUP BY g.query_id)
"""


def three_lists(spark, d):
    i = F.col("item_id")
    gold = table(spark, d, "benchmark").select(i.alias("query_id"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("document"))
    ranked = lexical.bm25(docs(spark, d), bench_terms(spark, d), 12, keep=["source"]).withColumnRenamed("source", "document")
    return gold, ranked


@query(
    bm25_sql(BENCH_Q)
    + SPLIT_LISTS_SQL
    + """SELECT count(*) AS n, count(*) FILTER (f IS NOT NULL) AS in_top, count(*) FILTER (f IS NULL AND (v IS NOT NULL OR l IS NOT NULL)) AS near,
        count(*) FILTER (f IS NULL AND v IS NULL AND l IS NULL) AS nowhere, count(*) FILTER (l IS NOT NULL AND v IS NULL) AS only_lexical,
        count(*) FILTER (v IS NOT NULL AND l IS NULL) AS only_vector FROM m"""
)
def retriever_contribution(spark, d):
    gold, ranked = three_lists(spark, d)
    second = ranked.filter("rank > 4").withColumn("rank", F.col("rank") - 4)
    return banks.retriever_contribution(gold, ranked, second, ranked, 4, 2)


@query(
    bm25_sql(BENCH_Q)
    + """, g AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS document FROM benchmark),
    m AS (SELECT g.query_id, min(rank) AS hit_rank FROM g LEFT JOIN (SELECT query_id, source, rank FROM ranked JOIN documents USING (doc_id) WHERE rank <= 12) r
        ON r.query_id = g.query_id AND r.source = g.document GROUP BY g.query_id), d2 AS (SELECT unnest([1, 5, 12]) AS depth)
    SELECT depth, round(avg(coalesce((hit_rank <= depth)::INT, 0)), 6) AS share FROM m, d2 GROUP BY depth"""
)
def ceiling_share(spark, d):
    gold, ranked = three_lists(spark, d)
    best = ranked.join(gold, ["query_id", "document"]).groupBy("query_id").agg(F.min("rank").alias("hit_rank"))
    return banks.ceiling(gold.join(best, "query_id", "left"), [1, 5, 12])


@query(
    """WITH v AS (SELECT quality = 1 AS j, CASE WHEN doc_id % 7 > 0 THEN toxic = 0 END AS h FROM labels)
    SELECT count(*) AS n, round(avg((j = h)::INT), 6) AS agreement, round(count(*) FILTER (j AND h) / count(*) FILTER (j), 6) AS precision,
        round(count(*) FILTER (j AND h) / count(*) FILTER (h), 6) AS recall FROM v WHERE h IS NOT NULL"""
)
def judge_agreement(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").alias("j"), F.when(F.col("doc_id") % 7 > 0, F.col("toxic") == 0).alias("h"))
    return banks.judge_agreement(rows, "j", "h")


@query(
    bm25_sql(BENCH_Q)
    + """, a AS (SELECT query_id, list(doc_id ORDER BY rank) AS l FROM ranked WHERE rank <= 5 GROUP BY query_id), k AS (SELECT unnest([1, 5]) AS k),
    b AS (SELECT query_id, list(doc_id ORDER BY CASE WHEN rank >= 4 AND query_id % 2 = 0 THEN -rank ELSE rank END) AS l FROM ranked WHERE rank <= 5 GROUP BY query_id)
    SELECT k, count(*) AS n, count(*) FILTER (a.l[1:k] = b.l[1:k]) AS same FROM a JOIN b USING (query_id), k GROUP BY k"""
)
def topk_identity(spark, d):
    a = lexical.bm25(docs(spark, d), bench_terms(spark, d), 5)
    swapped = F.when((F.col("rank") >= 4) & (F.col("query_id") % 2 == 0), -F.col("rank")).otherwise(F.col("rank"))
    return banks.same_top(a, a.withColumn("rank", swapped), [1, 5])


@query(
    bm25_sql(BENCH_Q)
    + """, a AS (SELECT query_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS list, rank FROM ranked WHERE rank <= 20),
    m AS (SELECT query_id, doc_id, min(row(list, rank)) AS m FROM a GROUP BY ALL)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY m, doc_id) AS place FROM m"""
)
def ordered_union(spark, d):
    a = lexical.bm25(docs(spark, d), bench_terms(spark, d), 20).withColumn("list", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2))
    lists = a.unionByName(a.filter("doc_id % 4 = 0").withColumn("list", F.lit(3)))
    return corpus.ordered_union(lists).select("query_id", "doc_id", F.col("place").cast("long").alias("place"))


@query()
def negative_pairs(spark, d):
    f = docs(spark, d).select(F.col("doc_id").alias("fragment"), "source", F.col("doc_id").alias("pos"))
    q = table(spark, d, "labels").join(docs(spark, d).select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("question"), "source", F.col("doc_id").alias("pos"))
    return banks.negative_pairs(f, q)


@query(
    bm25_sql(BENCH_Q)
    + """, g AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS own FROM benchmark),
    r AS (SELECT query_id, doc_id, source AS document, own, rank FROM ranked JOIN documents USING (doc_id) JOIN g USING (query_id) WHERE rank <= 8),
    a AS (SELECT query_id, list(doc_id ORDER BY rank) FILTER (rank <= 5) AS p, bool_or(rank <= 5 AND document = own) AS there,
        coalesce((list(doc_id ORDER BY rank) FILTER (document <> own))[1:5], []) AS d FROM r GROUP BY query_id)
    SELECT query_id, 'positive' AS kind, array_to_string(p, ',') AS fragments FROM a WHERE there
    UNION ALL SELECT query_id, 'negative', array_to_string(d, ',') FROM a WHERE len(d) >= 3"""
)
def multi_fragment_dataset(spark, d):
    gold, _ = three_lists(spark, d)
    ranked = lexical.bm25(docs(spark, d), bench_terms(spark, d), 8, keep=["source"]).withColumnRenamed("source", "document")
    out = banks.multi_fragment_dataset(gold, ranked)
    return out.select("query_id", "kind", F.array_join(F.transform("fragments", lambda x: x.cast("string")), ",").alias("fragments"))


# --- the stored index ----------------------------------------------------------


@query(bm25_sql(BENCH_Q) + "SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 24")
def bm25_from_index(spark, d):
    """Two segments inserted one after the other, made one, then searched."""
    parts, whole = shared_path(spark, "segments"), shared_path(spark, "index")
    lexical.write_index(docs(spark, d).filter("doc_id % 2 = 0"), parts)
    lexical.write_index(docs(spark, d).filter("doc_id % 2 = 1"), parts)
    lexical.optimize_index(spark, parts, whole)
    return lexical.bm25_index(spark, whole, bench_terms(spark, d), 24).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def named_vectors(spark, d):
    """The vectors under string ids, with null ones among them."""
    i = F.col("vec_id")
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("doc"), i.cast("string"), F.lit("::frag0")).alias("doc_id"), "embedding", "label")
    return rows.unionByName(rows.filter("label = 1").withColumns({"doc_id": F.concat("doc_id", F.lit("x")), "embedding": F.lit(None).cast(rows.schema["embedding"].dataType)}))


@query(
    f"""WITH v AS (SELECT 'doc' || vec_id || '::frag0' AS id, vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0),
    x AS (SELECT query_id, id, {L2} AS distance FROM v, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM x)
    SELECT query_id, id AS vec_id, distance, rank FROM r WHERE rank <= 10"""
)
def knn_string_ids(spark, d):
    q = table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    out = vector.knn(named_vectors(spark, d), q, 10, id_col="doc_id", block=16)  # so few that the grid of blocks is walked
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    bm25_sql(BENCH_Q, f"d AS (SELECT 'doc' || doc_id || '::frag0' AS doc_id, source, {toks('text')} AS w FROM documents)")
    + f""", v AS (SELECT vec_id, 'doc' || vec_id || '::frag0' AS doc_id, embedding::DOUBLE[] AS e FROM embeddings),
    x AS (SELECT a.vec_id AS query_id, b.doc_id, {L2.replace("e, qe", "a.e, b.e")} AS distance FROM v a, v b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
    vr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS vr FROM x),
    u AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, vr, lr FROM (SELECT * FROM vr WHERE vr <= 24) a
        FULL JOIN (SELECT query_id, doc_id, rank AS lr FROM ranked WHERE rank <= 24) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
    f AS (SELECT query_id, doc_id, vr, lr, round(coalesce(1.0 / (59 + vr), 0) + coalesce(0.8 / (59 + lr), 0), 9) AS score FROM u),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr NULLS LAST, lr NULLS LAST, doc_id) AS rank FROM f),
    hit AS (SELECT g.*, text, source FROM g JOIN documents t ON g.doc_id = 'doc' || t.doc_id || '::frag0' WHERE rank <= 8)
    SELECT query_id, doc_id, score, rank, source, md5(text) AS h FROM hit WHERE NOT (length(text) < 200 AND regexp_matches(upper(text),
        'COMUNÍQUESE|CÚMPLASE|DADO EN|FIRMA|MINISTRO|PRESIDENTE|CONGRESO'))"""
)
def search_end_to_end(spark, d):
    """Fragments with string ids: index written, both searches, fusion, late fetch, ceremonial filter."""
    path = shared_path(spark, "index")
    name = lambda c: F.concat(F.lit("doc"), F.col(c).cast("string"), F.lit("::frag0"))
    fragments = docs(spark, d).select(name("doc_id").alias("doc_id"), "text", "source")
    lexical.write_index(fragments, path, keep=["source"])
    vectors = table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id"), "left")
    asked = asked.select(F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("qvec"))
    hits = search.search(fragments, named_vectors(spark, d).filter("embedding is not null"), asked, 8, index=path)
    return hits.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"), "source", F.md5("texto").alias("h"))


@query(
    bm25_sql(BENCH_Q)
    + """, r AS (SELECT query_id, doc_id, rank, least(length(text), 4000) AS n FROM ranked JOIN documents USING (doc_id) WHERE rank <= 12),
    o AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN n END AS s FROM r), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS new_rank FROM o)
    SELECT query_id, doc_id, new_rank FROM z WHERE new_rank <= 5"""
)
def rerank_fallback(spark, d):
    """A scorer that fails on the odd queries: those keep their order."""

    def scorer(qs, ts):
        if any(q == "fail" for q in qs):
            raise RuntimeError("no model")
        return [float(len(t)) for t in ts]

    ranked = lexical.bm25(docs(spark, d), bench_terms(spark, d), 12).join(docs(spark, d).select("doc_id", F.col("text").alias("texto")), "doc_id")
    parts = []
    for odd in (0, 1):
        asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("fail" if odd else "go").alias("text"))
        parts.append(search.reranked(ranked.filter(F.col("query_id") % 2 == odd), asked, scorer, 5, 12))
    return parts[0].unionByName(parts[1]).select("query_id", "doc_id", F.col("new_rank").cast("long").alias("new_rank"))
