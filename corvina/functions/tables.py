"""Table functions for SQL: fragments of a text, to be joined laterally."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corvina.operators.chunking import CLOSING_SHARE, MAX_CHARS, MIN_CHARS, OVERLAP

# The expressions of corvina.operators.chunking as Python takes them.
_LINE = re.IGNORECASE | re.MULTILINE
_ARTICLE = re.compile(r"(?=^\s*ART[IÍ]CULO\s+\d+[oO°.]?)", _LINE)
_CLOSING = re.compile(
    r"^[ \t]*(?:COMUN[IÍ]QUESE|PUBL[IÍ]QUESE|NOT[IÍ]F[IÍ]QUESE|C[UÚ]MPLASE)"
    r"(?:[ \t,]+(?:Y|E)?[ \t,]*(?:PUBL[IÍ]QUESE|NOT[IÍ]F[IÍ]QUESE|C[UÚ]MPLASE|EJEC[UÚ]TESE))*[ \t]*[.…]?[ \t]*$"
    r"|^[ \t]*DADO\s+EN\b.{0,120}?\ba\s+los\b",
    _LINE,
)
_CEREMONIAL = re.compile(
    r"^[\s.,;:—-]*(?:(?:COMUN[IÍ]QUESE|PUBL[IÍ]QUESE|NOT[IÍ]F[IÍ]QUESE|C[UÚ]MPLASE|EJEC[UÚ]TESE|"
    r"DADO\s+EN|FIRMADO|EL\s+PRESIDENTE|EL\s+MINISTRO)\b[^\n]*[\s.,;:]*)+$",
    re.IGNORECASE,
)


def _windows(text: str) -> list[str]:
    step = MAX_CHARS - OVERLAP
    return [text] if len(text) <= MAX_CHARS else [text[i : i + MAX_CHARS] for i in range(0, len(text) - OVERLAP, step)]


def _packed(text: str) -> list[str]:
    if len(text) <= MAX_CHARS:
        return [text]
    paragraphs = [p for p in (x.strip() for x in re.split(r"\n\s*\n+", text)) if p]
    if len(paragraphs) <= 1:
        return _windows(text)
    done, open_ = [], ""
    for p in paragraphs:
        if len(p) <= MAX_CHARS and len(open_) + len(p) + 2 <= MAX_CHARS:
            open_ = f"{open_}\n\n{p}" if open_ else p
            continue
        done += [open_] if open_ else []
        open_ = "" if len(p) > MAX_CHARS else p
        done += _windows(p) if len(p) > MAX_CHARS else []
    return done + ([open_] if open_ else [])


def _without_closing(text: str) -> str:
    text = text.strip()
    found = _CLOSING.search(text, max(0, -int(-len(text) * CLOSING_SHARE // 1)))
    return (text[: found.start()].strip() if found else text) or text


def fragments_of(text: str | None, mode: str = "paragraphs") -> list[str]:
    """The fragments of one text, as corvina.operators.chunking.fragments() makes them."""
    if mode not in ("paragraphs", "size"):
        raise ValueError(f"unknown mode {mode!r}")
    inner, clean = _packed if mode == "paragraphs" else _windows, _without_closing(text or "")
    articles = [a for a in (x.strip() for x in _ARTICLE.split(clean)) if a]
    pieces = [p for a in articles for p in inner(a)] if len(articles) > 1 else inner(clean)
    stripped = [p.strip() for p in pieces]
    useful = [p for p in stripped if p and not (len(p) < MIN_CHARS and _CEREMONIAL.search(p))]
    return useful or ([clean.strip()] if clean.strip() else [])


@udtf(returnType=StructType([StructField("ord", IntegerType()), StructField("fragment", StringType())]))
class Fragments:
    """fragments(text[, mode]) -> (ord, fragment)"""

    def eval(self, text: str, mode: str = "paragraphs") -> Iterator[tuple[int, str]]:
        yield from enumerate(fragments_of(text, mode))


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: SELECT ... FROM docs, LATERAL fragments(docs.text) f"""
    spark.udtf.register("fragments", Fragments)
