"""Checks of an answer against the fragments it was given: claims, attribution, literal quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvina.functions.text import compared, quoted, sentences

# The five families of checkable claims.
_NORMS = (
    r"ley(?:es)?|decreto(?:s)?|resoluci[oó]n(?:es)?|circular(?:es)?|acuerdo(?:s)?|"
    r"ordenanza(?:s)?|sentencia(?:s)?|auto(?:s)?|concepto(?:s)?|oficio(?:s)?"
)
CLAIMS = {
    "norma": rf"(?iU)\b(?:{_NORMS})\b(?:\s+[A-ZÁÉÍÓÚÑ]{{2,}})?\s*(?:n[uú]mero\s*|n[°º.]\s*)?(\d{{1,5}})\s*(?:de|del)\s*(\d{{4}})",
    "articulo": r"(?iU)\bart[íi]culos?\b\.?\s*(\d+(?:\.\d+)*)|\bart\.\s*(\d+(?:\.\d+)*)",
    "sentencia": r"(?iU)\b([CTSU]{1,2}-\d{1,4})\s*[/ ]\s*(?:de\s*)?(\d{2,4})",
    "cantidad": r"(?iU)\b(\d{1,6})\s*(d[íi]as?|meses?|a[nñ]os?|horas?|smmlv|uvt|salarios?)\b",
    "porcentaje": r"(?U)\b(\d{1,3}(?:[.,]\d{1,2})?)\s*(?:%|por ciento)",
}
# Phrases about the search itself, and marks of an abstention.
META = ("no encontré", "no encontre", "no hay información", "no hay informacion", "el índice", "el indice", "no puedo determinar")
ABSTAINED = (
    "no encontré información suficiente", "no encontre informacion suficiente", "no está en el índice", "no esta en el indice",
    "no está indexad", "no esta indexad",
)
QUOTE = r"«[^»]{15,}»"
ELISION = r"\[\s*\.\.\.\s*\]|\[…\]|\.\.\.|…"
QUOTE_MARK = " [⚠ esta cita no aparece textualmente en las fuentes: compruébala]"


def _first(a: Column, b: Column) -> Column:
    return F.when(F.length(a) > 0, a).otherwise(b)


def _family(text: Column, kind: str, pattern: str) -> Column:
    def claim(m: Column) -> Column:
        first = F.regexp_extract(m, pattern, 1)
        if kind in ("norma", "sentencia"):
            key = F.concat(first, F.lit("|"), F.right(F.regexp_extract(m, pattern, 2), F.lit(2)))
        elif kind == "articulo":
            key = compared(_first(first, F.regexp_extract(m, pattern, 2)))
        else:
            key = compared(first)
        return F.struct(F.lit(kind).alias("tipo"), F.trim(m).alias("texto"), key.alias("clave"))

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), claim)


def claims(answer: Column) -> Column:
    """array<struct<tipo, texto, clave>>, one for each different (tipo, clave), in order of families and places."""
    text = F.coalesce(answer, F.lit(""))
    every = F.concat(*(_family(text, kind, pattern) for kind, pattern in CLAIMS.items()))

    def different(e: Column) -> Column:
        keys = F.transform(e, lambda x: F.concat(x["tipo"], F.lit("\n"), x["clave"]))
        return F.filter(e, lambda c, i: F.array_position(keys, F.concat(c["tipo"], F.lit("\n"), c["clave"])) == i + 1)

    return F.transform(F.array(every), different)[0]


def context(fragments: Column) -> Column:
    """The compared form of fragments (array<struct<identificador, titulo, texto>>), identifiers last."""
    texts = compared(F.array_join(F.transform(fragments, lambda f: F.coalesce(f["texto"], F.lit(""))), " \n "))
    names = F.transform(
        fragments, lambda f: F.concat(F.coalesce(f["identificador"], F.lit("")), F.lit(" "), F.coalesce(f["titulo"], F.lit("")))
    )
    return F.concat(texts, F.lit(" "), compared(F.array_join(names, " ")))


def supported(claim: Column, ctx: Column) -> Column:
    """Number and year within 20 non-digits of each other; other claims by their plain text."""
    number, year = F.split_part(claim["clave"], F.lit("|"), F.lit(1)), F.split_part(claim["clave"], F.lit("|"), F.lit(2))
    pattern = F.concat(F.lit(r"(?U)\Q"), number, F.lit(r"\E\D{0,20}(?:19|20)?"), year, F.lit(r"\b"))
    cited = claim["tipo"].isin("norma", "sentencia")
    return F.when(cited, F.regexp_like(ctx, pattern)).otherwise(F.contains(ctx, claim["clave"]))


def verified(answer: Column, fragments: Column) -> Column:
    """array<struct<tipo, texto, clave, respaldada>>."""
    return F.transform(
        F.array(context(fragments)),
        lambda ctx: F.transform(
            claims(answer),
            lambda c: F.struct(c["tipo"].alias("tipo"), c["texto"].alias("texto"), c["clave"].alias("clave"), supported(c, ctx).alias("respaldada")),
        ),
    )[0]


def _is_meta(sentence: Column) -> Column:
    out = F.lit(False)
    for m in META:
        out = out | F.contains(compared(sentence), F.lit(m))
    return out


def unsupported_sentences(answer: Column, checked: Column) -> Column:
    """Sentences with an unsupported claim that don't speak of the search itself."""
    bad = F.filter(checked, lambda c: ~c["respaldada"])
    return F.filter(sentences(answer), lambda s: F.exists(bad, lambda c: F.contains(s, c["texto"])) & ~_is_meta(s))


def marked(answer: Column, checked: Column) -> Column:
    """Unsupported claims are pointed out, not deleted."""
    bad = F.filter(checked, lambda c: ~c["respaldada"])
    return F.aggregate(
        bad, answer, lambda a, c: F.replace(a, c["texto"], F.concat(F.lit("⚠["), c["texto"], F.lit(": no está en las fuentes citadas]")))
    )


def cited_fragment(sentence: Column, fragments: Column) -> Column:
    """The first fragment that a sentence names, by its identifier or by the identifier's number and year."""
    s = compared(sentence)

    def names(f: Column) -> Column:
        ident = compared(f["identificador"])
        numbers = F.regexp_extract_all(ident, F.lit(r"\d+"), F.lit(0))
        pattern = F.concat(F.get(numbers, F.lit(0)), F.lit(r"\D{0,20}"), F.right(F.get(numbers, F.lit(1)), F.lit(2)), F.lit(r"\b"))
        by_number = F.when(F.size(numbers) >= 2, F.regexp_like(s, pattern)).otherwise(F.lit(False))
        return (F.length(ident) >= 4) & (F.contains(s, ident) | by_number)

    return F.get(F.filter(fragments, names), F.lit(0))


def attribution(answer: Column, fragments: Column) -> Column:
    """Per sentence that names a fragment: its claims, checked in that fragment alone. A diagnosis, not a gate."""

    def check(s: Column) -> Column:
        cited = cited_fragment(s, fragments)
        own = lambda c: c["tipo"].isin("norma", "sentencia") & cited_fragment(c["texto"], F.array(cited)).isNotNull()
        found = F.transform(
            claims(s),
            lambda c: F.struct(c["tipo"].alias("tipo"), c["texto"].alias("texto"), (own(c) | supported(c, context(F.array(cited)))).alias("respaldada")),
        )
        return F.struct(s.alias("frase"), cited["identificador"].alias("citado"), found.alias("afirmaciones"))

    return F.filter(F.transform(F.filter(sentences(answer), lambda s: ~_is_meta(s)), check), lambda r: r["citado"].isNotNull())


def literal_quotes(answer: Column, texts: Column) -> Column:
    """struct<buenas, total>: quotes in «» that stand in the texts; an elided quote is checked piece by piece."""
    ctx = quoted(F.array_join(texts, " "))

    def good(q: Column, c: Column) -> Column:
        inner = quoted(F.substring(q, F.lit(2), F.length(q) - 2))
        pieces = F.filter(F.transform(F.split(inner, ELISION), F.trim), lambda p: F.length(p) >= 15)
        return (F.size(pieces) > 0) & F.forall(pieces, lambda p: F.contains(c, p))

    quotes = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(QUOTE), F.lit(0))
    return F.transform(
        F.array(ctx),
        lambda c: F.struct(F.size(F.filter(quotes, lambda q: good(q, c))).alias("buenas"), F.size(quotes).alias("total")),
    )[0]


def abstained(answer: Column) -> Column:
    out = F.lit(False)
    for m in ABSTAINED:
        out = out | F.contains(quoted(answer), quoted(F.lit(m)))
    return out


def support_verdict(answer: Column, texts: Column) -> Column:
    """struct<aceptada, motivo> for answers that were written on weak retrieval."""
    q = literal_quotes(answer, texts)
    reason = (
        F.when(abstained(answer), "Los fragmentos encontrados no responden la consulta.")
        .when(q["total"] == 0, "La respuesta no cita textualmente ninguna norma de las encontradas.")
        .when(
            q["buenas"] < q["total"],
            F.concat(
                (q["total"] - q["buenas"]).cast("string"), F.lit(" de "), q["total"].cast("string"),
                F.lit(" citas de la respuesta no aparecen literalmente en las fuentes encontradas."),
            ),
        )
        .otherwise("")
    )
    return F.struct((reason == "").alias("aceptada"), reason.alias("motivo"))


def mark_quotes(answer: Column, texts: Column) -> Column:
    """Quotes that are not literal get a mark behind them."""
    quotes = F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(QUOTE), F.lit(0)))
    return F.aggregate(
        F.filter(quotes, lambda q: literal_quotes(q, texts)["buenas"] == 0), answer, lambda a, q: F.replace(a, q, F.concat(q, F.lit(QUOTE_MARK)))
    )
