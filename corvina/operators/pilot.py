"""Checks of a pilot's answers, rewritten queries, and the vocabulary bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions.text import quoted, strip
from corvina.operators.grounding import QUOTE, abstained

# What names a norm, what warns of its validity, and forms that say until when a rule held.
NAMES_NORM = r"(?iu)\b(?:ley|decreto|resoluci[oó]n|circular|oficio|concepto|sentencia|auto|art[ií]culo)\b"
VALIDITY_MARKS = (
    "derogad", "inexequible", "no compilado", "sustituid", "ya no está vigente", "ya no esta vigente", "no sigue vigente", "caduc",
)
TIME_LIMIT = (
    r"(?iU)\b(?:hasta\s+(?:el\s+a[ñn]o\s+|finales\s+de\s+|)\d{4}|a\s+partir\s+del?\s+(?:a[ñn]o\s+)?\d{4}"
    r"|rigi[óo]\s+hasta|estuvo\s+vigente\s+hasta)\b"
)
NORM = r"(?iU)\b(ley|decreto|decreto ley|resoluci[oó]n|circular)\s+([\d.]+)\s+de\s+(\d{4})"
MAX_WORDS, LEAST_DISTINCT, LEAST_WORDS = 16, 0.55, 3
# Colloquial words and how the norms name them.
BRIDGE = {
    "echaron": ("despido", "terminacion unilateral", "contrato"),
    "echar": ("despido", "terminacion"),
    "botaron": ("despido", "terminacion unilateral"),
    "botar": ("despido", "terminacion"),
    "sacaron": ("despido", "terminacion"),
    "renuncie": ("renuncia", "terminacion voluntaria"),
    "sueldo": ("salario", "remuneracion"),
    "plata": ("dinero", "suma", "pago"),
    "jefe": ("empleador", "patrono"),
    "trabajador": ("empleado", "servidor"),
    "incapacitado": ("incapacidad", "estabilidad laboral reforzada"),
    "embarazada": ("fuero de maternidad", "estabilidad laboral reforzada", "licencia"),
    "prima": ("prestaciones sociales", "prima de servicios"),
    "liquidacion": ("prestaciones sociales", "cesantias", "indemnizacion"),
    "arriendo": ("arrendamiento", "canon"),
    "casero": ("arrendador",),
    "inquilino": ("arrendatario",),
    "recibo": ("factura", "facturacion"),
    "luz": ("energia electrica", "servicio publico domiciliario"),
    "agua": ("acueducto", "servicio publico domiciliario"),
    "basura": ("aseo", "residuos solidos"),
    "cobran": ("cobro", "facturacion", "tarifa"),
    "eps": ("entidad promotora de salud", "sistema de seguridad social"),
    "pension": ("pension", "prestacion economica", "regimen pensional"),
    "jubilacion": ("pension de vejez",),
    "medicamento": ("suministro", "prestacion asistencial"),
    "cita": ("atencion", "servicio de salud"),
    "demandar": ("demanda", "accion judicial", "proceso"),
    "denunciar": ("denuncia", "querella"),
    "reclamar": ("reclamacion", "peticion", "recurso"),
    "queja": ("reclamacion", "peticion", "recurso de reposicion"),
    "papeles": ("documentos", "requisitos"),
    "tramite": ("procedimiento", "actuacion administrativa"),
    "multa": ("sancion", "comparendo"),
    "estafa": ("estafa", "fraude", "engano"),
    "negocio": ("establecimiento de comercio", "actividad mercantil"),
    "socio": ("socio", "accionista"),
    "empresa": ("sociedad", "persona juridica"),
    "impuesto": ("tributo", "obligacion tributaria"),
    "factura": ("factura", "documento equivalente"),
    "deuda": ("obligacion", "acreencia"),
    "cobrador": ("acreedor", "cobranza"),
    "divorcio": ("cesacion de efectos civiles", "disolucion"),
    "hijos": ("menores", "custodia", "alimentos"),
    "cuota": ("alimentos", "cuota alimentaria"),
    "herencia": ("sucesion", "herederos"),
}


def has_format(answer: Column) -> Column:
    """The answer names a norm, quotes, and is longer than 180 characters."""
    a = F.coalesce(answer, F.lit(""))
    return a.rlike(NAMES_NORM) & a.rlike(QUOTE) & (F.length(a) > 180)


def warned_of_validity(answer: Column) -> Column:
    a = F.coalesce(answer, F.lit(""))
    found = a.rlike(TIME_LIMIT)
    for m in VALIDITY_MARKS:
        found = found | F.contains(quoted(a), quoted(F.lit(m)))
    return found


def norm_name(text: Column) -> Column:
    """The first "kind number de year" of a text in its compared form, or the empty string."""
    t = F.coalesce(text, F.lit(""))
    parts = [F.regexp_extract(t, NORM, k) for k in (1, 2, 3)]
    return F.when(parts[0] == "", "").otherwise(quoted(F.concat_ws(" ", parts[0], parts[1], F.lit("de"), parts[2])))


def fell_into_trap(answer: Column, trap: Column) -> Column:
    """A norm that no longer holds is given as if it did: named, with neither abstention nor warning."""
    name = norm_name(trap)
    return ~abstained(answer) & ~warned_of_validity(answer) & (name != "") & F.contains(quoted(answer), name)


def pilot_report(answers: DataFrame, by: list[str]) -> DataFrame:
    """Shares over all and by each column of by; answers: respuesta, trampa, debe_abstenerse, buenas, total and the columns of by."""
    r = F.col("respuesta")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    aggs = [
        F.count("*").alias("n"),
        F.round(F.sum("buenas") / F.nullif(F.sum("total"), F.lit(0)), 6).alias("literal_rate"),
        share(has_format(r)).alias("format_rate"),
        share(F.when(F.col("debe_abstenerse"), abstained(r))).alias("due_abstention"),
        share(F.when(F.col("trampa").isNotNull(), ~fell_into_trap(r, F.col("trampa")))).alias("traps_avoided"),
    ]
    return answers.groupingSets([[], *([F.col(c)] for c in by)], *(F.col(c) for c in by)).agg(*aggs)


def rewritten(original: Column, produced: Column) -> Column:
    """A model's rewriting if it is usable, else the query itself.

    Its first line, words once each and at most 16; degenerate (many repeats) or too short ones fall back.
    """
    line = strip(F.split_part(strip(F.coalesce(produced, F.lit(""))), F.lit("\n"), F.lit(1)))
    line = strip(F.regexp_replace(F.regexp_replace(line, r"(?iu)^t[ée]rminos:\s*", ""), r"^[\"'«]+|[\"'»]+$", ""))
    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    lowered = F.transform(words, F.lower)
    repeated = (F.size(words) >= 4) & (F.size(F.array_distinct(lowered)) / F.size(words) < LEAST_DISTINCT)
    compact = F.slice(F.filter(words, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1), 1, MAX_WORDS)
    return F.when(repeated | (F.size(words) < LEAST_WORDS), original).otherwise(F.array_join(compact, " "))


def ranked_choice(answer: Column, n: Column, top: int = 5) -> Column:
    """The first top different numbers between 1 and n that a model's answer names, in order."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\d{1,9}"), F.lit(0)), lambda x: x.cast("int"))
    return F.slice(F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= n))), 1, top)


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 in hex, from sha2 over the padded keys; key: ASCII of at most 64 bytes."""
    raw = key.encode().ljust(64, b"\0")
    if len(raw) > 64:
        raise ValueError("the key must have at most 64 bytes")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in raw).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def address_print(address: Column, salt: str, digits: int = 32) -> Column:
    """The fingerprint of an address under the salt of a day (ASCII): the first digits of its HMAC. The salt goes with the day."""
    return F.when(address.isNotNull(), F.concat(F.lit("ip:"), F.substring(hmac_sha256(address, salt), 1, digits)))
