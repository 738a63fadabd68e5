"""The bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.encode(col.cast("string"), "UTF-8")), F.lit(modulus))


def sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, modulus: int, held: int, limit: int
) -> DataFrame:
    """(id, text as bytes, label int) of at most limit labelled rows outside the held-out fold, by the order of their hashes.

    The chosen ids are at most limit rows of two numbers, so they are broadcast. An id counts once: of rows that repeat it
    the least text is taken, of labels that repeat it the least label.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .filter(fold("id", modulus) != held)
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(limit)
    )
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return src.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")
