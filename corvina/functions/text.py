"""Text kernel: folding, tokens, dates, encoding repair, redaction, identifiers. Built-in expressions only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish words without discriminating value, with courtesy formulas.
STOP_WORDS = (
    "a al algo alguna algunas alguno algunos ante antes aqui asi aun aunque bien buenas buenos "
    "cada como con contra cual cuales cuando da dar de del desde dias dice decir donde dos el ella ellas "
    "ellos en entre era eran es esa esas ese eso esos esta estan estas este esto estos estoy favor fue "
    "fueron gracias ha hace hacer hacia han hasta hay hola la las le les lo los mas me mi mia mio mis "
    "mucho muy nada ni no noches nos nosotros o os otra otras otro otros para pero poco por porque pregunta "
    "puede pueden podria que quien quienes se senor senora ser seria si sin sobre solo son soy su sus "
    "tambien tanto tardes te tener tengo tiene tienen todo todos tu tus un una uno unos usted ustedes ya "
    "yo consulta"
).split()
MAX_TERMS = 12
MIN_TERM_LENGTH = 3
# Months of Spanish dates.
MONTHS = {
    "enero": "01", "febrero": "02", "marzo": "03", "abril": "04", "mayo": "05", "junio": "06", "julio": "07",
    "agosto": "08", "septiembre": "09", "octubre": "10", "noviembre": "11", "diciembre": "12",
}
# What looks like a key or a credential.
SECRET_PATTERNS = (
    r"sk-[A-Za-z0-9_\-]{8,}",
    r"AIza[A-Za-z0-9_\-]{8,}",
    r"(?i)(authorization|x-api-key|api[_-]?key)\s*[:=]\s*\S+",
)
REDACTED = "[clave omitida]"
# Traces of text that was decoded twice.
MOJIBAKE = "Ã[\\x{80}-\\x{BF}¡-¿]|â€|Â[^\\s\\d]"
TOKEN = r"[\p{L}\p{N}_]+"


def _folding() -> tuple[str, str]:
    """Every character of the basic plane whose compatibility decomposition in lower case leaves one other character, full
    width and super- and subscripts included; combining marks go. What decomposes into several characters (ligatures,
    fractions) stays as it is, as a translation is by single characters."""
    source, target, marks = [], [], []
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]:
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            source.append(c)
            target.append(base)
    return "".join(source + marks), "".join(target)


_FROM, _TO = _folding()


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), _FROM, _TO)


def strip(text: Column) -> Column:
    """Outer white space off, Unicode white space included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """All tokens of a text, folded, in order."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_terms(text: Column, cap: int = MAX_TERMS) -> Column:
    """Useful terms of a query: not short, not stop words, different, at most cap; if none is left, its first tokens."""
    raw = tokens(text)
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    useful = F.slice(
        F.array_distinct(F.filter(raw, lambda t: (F.length(t) >= MIN_TERM_LENGTH) & ~F.array_contains(stop, t))), 1, cap
    )
    return F.when(F.size(useful) > 0, useful).otherwise(F.slice(raw, 1, cap))


def fts_expression(terms: Column) -> Column:
    """The OR of the quoted terms, as a full-text engine takes it."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def has_mojibake(text: Column, head: int = 5000) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, head).rlike(MOJIBAKE)


def _redecoded(text: Column) -> Column:
    """text as Latin-1 bytes read as UTF-8; null where either step is impossible."""
    latin = F.when(text.rlike(r"^[\x{00}-\x{FF}]*$"), F.encode(text, "ISO-8859-1"))
    raw = latin.cast("string")
    return F.when(F.is_valid_utf8(raw), raw)


def fix_mojibake(text: Column) -> Column:
    """Undo a double decoding: the whole text at once, or else each word for itself."""
    parts = F.split(text, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")
    return F.coalesce(_redecoded(text), F.array_join(F.transform(parts, lambda p: F.coalesce(_redecoded(p), p)), ""))


def spanish_date_to_iso(text: Column) -> Column:
    """The first "D de MES de YYYY" as ISO date; without one the text itself."""
    pattern = r"(?i)(\d{1,2})\s+de\s+(" + "|".join(MONTHS) + r")\s+de\s+(\d{4})"
    day, month, year = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    number = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))[F.lower(month)]
    return F.when(text.rlike(pattern), F.concat_ws("-", year, number, F.lpad(day.cast("int").cast("string"), 2, "0"))).otherwise(text)


def redact(text: Column) -> Column:
    for pattern in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def document_of(fragment_id: Column) -> Column:
    """What stands before the last "::"."""
    return F.when(fragment_id.contains("::"), F.regexp_extract(fragment_id, r"(?s)^(.*)::", 1)).otherwise(fragment_id)


def source_of(document_id: Column) -> Column:
    return F.split_part(document_id, F.lit(":"), F.lit(1))


def compared(text: Column) -> Column:
    """Lower case, no accents, white space collapsed: the form in which claims are looked up."""
    return F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")


def quoted(text: Column) -> Column:
    """As compared(), with all quotation marks alike and no outer white space: the form for literal quotes."""
    t = F.translate(F.coalesce(text, F.lit("")), "“”«»’‘", "\"\"\"\"''")
    return F.regexp_replace(F.regexp_replace(fold(t), r"(?U)[\s\x{A0}]+", " "), r"^ | $", "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), r"(?U)(?<=[.;:])\s+"), lambda s: F.length(strip(s)) > 0)
