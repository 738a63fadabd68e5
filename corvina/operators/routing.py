"""Who answers: the route of each query from its ranked, annotated hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLEAR_SCORE, CLEAR_RATIO, WEAK_SCORE, CONSIDERED = 0.045, 1.15, 0.020, 5
# The reasons that go with each decision.
REASONS = {
    "none": "La búsqueda no encontró nada en el índice.",
    "weak": "Coincidencia débil: solo un método de búsqueda encontró estos documentos.",
    "clear": "Un documento destaca con claridad: el modelo propio basta.",
    "external": "Varios documentos compiten y hay que discriminar entre ellos.",
    "local": "Consulta difícil y sin clave de IA externa configurada: responde el modelo propio, con menos confianza.",
}
# What is said where all that was found no longer holds, and behind an abstention.
GONE = ("Lo único que el índice tiene sobre esto son normas que ya no rigen según su propia nota oficial", ". Busca la norma que las reemplazó.")
COVERAGE = (
    "Ten en cuenta dos huecos conocidos de cobertura: el Consejo de Estado no está en el índice porque su portal bloquea el acceso "
    "automatizado, y la Corte Suprema tampoco porque su servidor de consulta lleva meses fallando. Además el índice es una instantánea: "
    "no refleja normas ni sentencias posteriores a su última actualización."
)
REPHRASE = "Prueba a reformular con los términos que usaría la norma (por ejemplo «terminación unilateral del contrato» en vez de «me echaron»)."


def decide(
    queries: DataFrame, hits: DataFrame, external_key: bool = False, clear: float = CLEAR_SCORE, ratio: float = CLEAR_RATIO, weak: float = WEAK_SCORE
) -> DataFrame:
    """(query_id, motor, motivo, responde, puede_redactar); hits: (query_id, rank, score, not_valid[, titulo]).

    If all the first hits are norms that no longer hold, the reason names them (their titulo, in rank order, each once).
    """
    title = F.col("titulo") if "titulo" in hits.columns else F.lit(None).cast("string")
    considered = F.collect_list(F.when((F.col("rank") <= CONSIDERED) & title.isNotNull(), F.struct(F.col("rank").alias("r"), title.alias("t"))))
    best = hits.groupBy("query_id").agg(
        F.array_join(F.array_distinct(F.transform(F.array_sort(considered), lambda x: x["t"])), ", ").alias("names"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.every(F.when(F.col("rank") <= CONSIDERED, F.col("not_valid"))).alias("all_gone"),
    )
    q = queries.select("query_id").join(best, "query_id", "left")
    second = F.coalesce("second", F.lit(0.0))
    stands_out = (F.col("first") >= clear) & ((second == 0) | (F.col("first") / F.nullif(second, F.lit(0.0)) >= ratio))
    which = (
        F.when(F.col("first").isNull(), "none")
        .when(F.coalesce("all_gone", F.lit(False)), "gone")
        .when(F.col("first") < weak, "weak")
        .when(stands_out, "clear")
        .otherwise("external" if external_key else "local")
    )
    motor = (
        F.when(F.col("w").isin("none", "gone"), "abstenerse")
        .when(F.col("w") == "weak", "condicional")
        .when(F.col("w") == "external", "externo")
        .otherwise("local")
    )
    found = F.when(F.coalesce("names", F.lit("")) != "", F.concat(F.lit(": "), F.col("names"))).otherwise("")
    gone = F.concat(F.lit(GONE[0]), found, F.lit(GONE[1]))
    reason = F.coalesce(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))[F.col("w")], gone)
    out = q.withColumn("w", which).select("query_id", motor.alias("motor"), reason.alias("motivo"))
    return out.withColumns({"responde": F.col("motor").isin("local", "externo"), "puede_redactar": F.col("motor") != "abstenerse"})


def abstention_message(n_fragments: int | None, n_sources: int = 7) -> str:
    """Why there is no answer, with the size of what was searched."""
    if n_fragments:
        scope = f"Busqué en {n_fragments:,} fragmentos de {n_sources} fuentes oficiales.".replace(",", ".")
    else:
        scope = f"Busqué en el índice completo ({n_sources} fuentes oficiales)."
    return f"No encontré nada suficientemente cercano a tu consulta. {scope}\n\n{COVERAGE}\n\n{REPHRASE}"
