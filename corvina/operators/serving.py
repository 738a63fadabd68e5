"""What stands between a search and its users: checked requests, prompts, tool outputs, point lookups, plug-in models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions.text import document_of, strip
from corvina.operators import validity
from corvina.shared import small

# Limits of what clients may ask.
MAX_QUERY, MAX_RESULTS, DEFAULT_RESULTS = 1000, 20, 5
SERVER_MOST, SERVER_DEFAULT, SERVER_BODY = 50, 8, 64 * 1024
VALID_ID = r"(?U)^[\w.:\-]{1,200}$"
# Words of suggestions that are no legal queries.
JUNK = (
    r"(?i)\b(meme|memes|cancion|letra|pelicula|serie|novela|frases?|chistes?|como se escribe|en ingles|significado biblico|"
    r"sue[nñ]o|suenos?|youtube|tiktok|facebook|whatsapp|instagram)\b"
)
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def prefixed(text: Column, model: str, kind: str, mode: str = "") -> Column:
    """text with "query: " or "passage: " in front where the model wants them; mode e5 or ninguno decides over the name."""
    wanted = mode in ("e5", "si", "sí") or (mode not in ("ninguno", "no") and "e5" in model.lower())
    return F.concat(F.lit(f"{kind}: "), text) if wanted else text


def json_block(text: Column, schema: str) -> Column:
    """The outermost {...} of a model's answer, parsed; null where there is none or it is no such object."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(block).isNotNull(), F.from_json(block, schema))


def snippet(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def useful_query(text: Column, least_words: int = 4) -> Column:
    """A suggestion of at least so many words without a word of JUNK."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(strip(t), r"(?U)\s+"), lambda w: w != "")
    return (F.size(words) >= least_words) & ~t.rlike(JUNK)


def known_sources(asked: Column, catalogue: list[str]) -> Column:
    """The asked sources that the catalogue has; null (no filter) where nothing is asked or nothing is left."""
    left = F.filter(asked, lambda s: s.isin(catalogue))
    return F.when(F.size(left) > 0, left)


def tool_requests(requests: DataFrame, text: str, n: str) -> DataFrame:
    """requests with consulta (outer white space off, cut), k (1 to MAX_RESULTS) and empty."""
    cut = F.substring(strip(F.coalesce(text, F.lit(""))), 1, MAX_QUERY)
    number = F.col(n).cast("string").try_cast("int")
    k = F.greatest(F.lit(1), F.least(F.coalesce(F.when(number != 0, number), F.lit(DEFAULT_RESULTS)), F.lit(MAX_RESULTS)))
    return requests.select("*", cut.alias("consulta"), k.alias("k"), (cut == "").alias("empty"))


def server_requests(raw: DataFrame, body: str, catalogue: list[str]) -> DataFrame:
    """raw with status (200, 400 or 413), error, consulta, n, fuentes of a JSON body."""
    kind = lambda path: F.call_function("schema_of_variant", F.try_variant_get("_v", path, "variant"))
    out = raw.withColumn("_v", F.try_parse_json(F.coalesce(body, F.lit(""))))
    text, number = F.try_variant_get("_v", "$.consulta", "string"), F.try_variant_get("_v", "$.n", "long")
    whole = F.startswith(F.coalesce(F.call_function("schema_of_variant", F.col("_v")), F.lit("")), F.lit("OBJECT"))
    text_kind, n_kind, sources_kind = kind("$.consulta"), kind("$.n"), kind("$.fuentes")
    given = F.coalesce(n_kind, F.lit("absent"))
    sources = F.coalesce(sources_kind, F.lit("VOID"))
    error = (
        F.when(F.octet_length(F.coalesce(body, F.lit(""))) > SERVER_BODY, "Cuerpo demasiado grande.")
        .when(F.col("_v").isNull(), "El cuerpo no es JSON válido.")
        .when(~whole, "El cuerpo debe ser un objeto JSON.")
        .when((_or(text_kind, "") != "STRING") | (strip(_or(text, "")) == ""), "Falta el campo 'consulta' (texto no vacío).")
        .when((given != "absent") & ((given != "BIGINT") | (F.coalesce(number, F.lit(0)) < 1)), "El campo 'n' debe ser un entero mayor o igual a 1.")
        .when(~sources.isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>"), "El campo 'fuentes' debe ser una lista de textos.")
    )
    status = F.when(error.isNull(), 200).when(error == "Cuerpo demasiado grande.", 413).otherwise(400)
    ok = lambda c: F.when(error.isNull(), c)
    filtered = known_sources(F.try_variant_get("_v", "$.fuentes", "array<string>"), catalogue)
    return out.select(
        "*", status.alias("status"), error.alias("error"), ok(text).alias("consulta"),
        ok(F.least(F.coalesce(number, F.lit(SERVER_DEFAULT)), F.lit(SERVER_MOST))).alias("n"), ok(filtered).alias("fuentes"),
    ).drop("_v")


def _document(hit: Column, delimited: bool) -> Column:
    v = hit["vigencia"]
    state = F.when(v["estado"] == validity.NO_NOTE, "").otherwise(F.concat(F.lit("Vigencia: "), validity.label(v), F.lit("\n")))
    text = F.replace(_or(hit["texto"], ""), F.lit("</documento>"), F.lit("</ documento>"))  # a text must not end its own block
    body = F.concat(
        F.lit("### "), F.coalesce(hit["titulo"], hit["identificador"], F.lit("")), F.lit("\nFuente: "), _or(hit["fuente"], "None"),
        F.lit(" | Identificador: "), _or(hit["identificador"], "None"), F.lit("\n"), state, text, F.lit("\n"),
    )
    return F.concat(F.lit("<documento>\n"), body, F.lit("</documento>")) if delimited else body


def _by_query(hits: DataFrame, columns: list[str]) -> DataFrame:
    """(query_id, hs): the hits of each query in the order of their rank; a query has as many as its search returned."""
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("hs"))


def prompts(queries: DataFrame, hits: DataFrame, system: str, delimited: bool = True) -> DataFrame:
    """(query_id, prompt). hits: (query_id, rank, titulo, identificador, fuente, texto, vigencia: the struct of annotate()).

    Each fragment stands between delimiters that its text can't close, with its validity as a line of its own above it.
    """
    found = _by_query(hits, ["titulo", "identificador", "fuente", "texto", "vigencia"])
    blocks = F.array_join(F.transform("hs", lambda h: _document(h, delimited)), "\n" if delimited else "\n---\n")
    joined = queries.select("query_id", "text").join(found, "query_id", "left")
    prompt = F.concat(
        F.lit(f"{system}\n\nFragmentos disponibles:\n\n"), _or(blocks, ""), F.lit("\n\nPregunta: "), F.col("text"), F.lit("\n\nRespuesta:")
    )
    return joined.select("query_id", prompt.alias("prompt"))


def tool_results(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, output): what the search tool says. requests: tool_requests() with query_id; hits as for prompts(), with id and url."""
    found = _by_query(hits, ["titulo", "identificador", "fuente", "id", "url", "texto", "vigencia"])
    part = lambda h: F.concat(
        F.lit("### "), _or(h["titulo"], "None"), F.lit("\nFuente: "), _or(h["fuente"], "None"), F.lit(" | Identificador: "),
        _or(h["identificador"], "None"), F.lit(" | Fragmento: "), _or(h["id"], "None"), F.lit("\nURL: "), _or(h["url"], "None"),
        F.lit("\nVigencia: "), validity.label(h["vigencia"]), F.lit("\n<fragmento>\n"), _or(h["texto"], ""), F.lit("\n</fragmento>\n"),
    )
    text = F.array_join(F.transform(F.slice("hs", F.lit(1), F.col("k")), part), "\n---\n")
    output = F.when(F.col("empty"), "Consulta vacía.").otherwise(_or(text, "Sin resultados en el índice actual para esta consulta."))
    return requests.join(found, "query_id", "left").select("query_id", output.alias("output"))


def read_fragments(requests: DataFrame, fragments: DataFrame, table: DataFrame) -> DataFrame:
    """(request_id, output): whole fragments by id. requests: (request_id, fragment_id); fragments: (id, titulo, url, texto)."""
    asked = requests.select("request_id", strip(F.coalesce("fragment_id", F.lit(""))).alias("_id"))
    valid = F.col("_id").rlike(VALID_ID) & F.contains("_id", F.lit("::"))
    wanted = small(asked.filter(valid).select(F.col("_id").alias("id")).distinct())
    found = validity.annotate(fragments.join(wanted, "id", "left_semi"), table)
    text = F.concat(
        F.lit("### "), _or(F.col("titulo"), "None"), F.lit("\nURL: "), _or(F.col("url"), "None"), F.lit("\nVigencia: "),
        validity.label(F.col("vigencia")), F.lit("\n<fragmento>\n"), _or(F.col("texto"), ""), F.lit("\n</fragmento>"),
    )
    answers = asked.join(found.select(F.col("id").alias("_id"), text.alias("_text")), "_id", "left")
    output = F.when(~valid, "Identificador de fragmento inválido.").otherwise(_or(F.col("_text"), "No existe ese fragmento en el índice."))
    return answers.select("request_id", output.alias("output"))


def validity_answers(requests: DataFrame, table: DataFrame) -> DataFrame:
    """(request_id, output): what is known of documents. requests: (request_id, document_id); table: validity_table()."""
    asked = requests.select("request_id", strip(F.coalesce("document_id", F.lit(""))).alias("_id"))
    rows = table.select(F.col("document_id").alias("_doc"), "estado", "texto", "por")
    found = asked.withColumn("_doc", document_of(F.col("_id"))).join(rows, "_doc", "left")
    by = F.when(_or(F.col("por"), "") != "", F.concat(F.lit(" Por: "), "por", F.lit("."))).otherwise("")
    output = (
        F.when(~F.col("_id").rlike(VALID_ID), "Identificador inválido.")
        .when(
            F.col("estado").isNull(),
            F.concat("_id", F.lit(
                ": sin nota de vigencia de alcance documental en el índice. No prueba que esté vigente; verifica en SUIN-Juriscol o en la "
                "fuente oficial."
            )),
        )
        .otherwise(F.concat("_id", F.lit(": "), F.upper("estado"), F.lit(". Nota oficial: «"), "texto", F.lit("»."), by))
    )
    return found.select("request_id", output.alias("output"))


def by_id(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows with the ids of wanted: a semi-join; a few ids are sent to the scan."""
    return rows.join(small(wanted.select(key).distinct()), key, "left_semi")


def encoded(texts: DataFrame, text_col: str, encoder: Callable[[], Callable[[list[str]], list]], out: str = "embedding", batch: int = 256) -> DataFrame:
    """texts with the vectors of a plug-in encoder. encoder() runs once in a task and gives a function of a list of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for b in batches:
            found: list = []
            for lo in range(0, len(b), batch):
                found += [[float(x) for x in v] for v in encode(b[text_col].iloc[lo : lo + batch].fillna("").tolist())]
            yield b.assign(**{out: found})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInPandas(run, f"{schema}, `{out}` array<double>")


def completed(prompts_: DataFrame, prompt_col: str, model: Callable[[], Callable[[str], str]], out: str = "respuesta") -> DataFrame:
    """prompts with the answers of a plug-in language model; a call that fails gives null and its reason in error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = model()
        for b in batches:
            said, errors = [], []
            for p in b[prompt_col]:
                try:
                    said.append(complete(p or ""))
                    errors.append(None)
                except Exception as e:  # whatever a plug-in raises
                    said.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield b.assign(**{out: said, "error": errors})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts_.schema)
    return prompts_.mapInPandas(run, f"{schema}, `{out}` string, error string")


def stop_if_all_fail(calls: DataFrame, order: str, error: str, first: int = 5) -> None:
    """Raise if the first so many calls of a run all failed: the service is down, and going on would only cost time."""
    rows = calls.orderBy(order).limit(first).select(F.col(error).isNotNull().alias("failed")).collect()
    if len(rows) == first and all(r["failed"] for r in rows):
        raise RuntimeError(f"the first {first} calls failed")
