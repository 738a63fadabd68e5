"""Documents to citable fragments: closing formulas, articles, paragraphs, size windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions.text import strip

MAX_CHARS, MIN_CHARS, OVERLAP, CLOSING_SHARE = 1500, 150, 200, 0.7
# The start of an article, the closing formulas of an act, and pieces that are formula alone.
ARTICLE = r"(?imud)(?=^\s*ART[IÍ]CULO\s+\d+[oO°.]?)"
CLOSING = (
    r"(?imud)^[ \t]*(?:COMUN[IÍ]QUESE|PUBL[IÍ]QUESE|NOT[IÍ]F[IÍ]QUESE|C[UÚ]MPLASE)"
    r"(?:[ \t,]+(?:Y|E)?[ \t,]*(?:PUBL[IÍ]QUESE|NOT[IÍ]F[IÍ]QUESE|C[UÚ]MPLASE|EJEC[UÚ]TESE))*[ \t]*[.…]?[ \t]*$"
    r"|^[ \t]*DADO\s+EN\b.{0,120}?\ba\s+los\b"
)
ONLY_CEREMONIAL = (
    r"(?iud)^[\s.,;:—-]*(?:(?:COMUN[IÍ]QUESE|PUBL[IÍ]QUESE|NOT[IÍ]F[IÍ]QUESE|C[UÚ]MPLASE|EJEC[UÚ]TESE|"
    r"DADO\s+EN|FIRMADO|EL\s+PRESIDENTE|EL\s+MINISTRO)\b[^\n]*[\s.,;:]*)+$"
)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def without_closing(text: Column) -> Column:
    """The text up to the first closing formula that starts at 70 % or later; never empty for a text that was not."""

    def cut(t: Column) -> Column:
        start = F.ceil(F.length(t) * CLOSING_SHARE).cast("int")
        # the tail is searched with the character before it, so that its first place is no false line start
        head = F.greatest(start - 1, F.lit(0))
        tail = F.substring(t, head + 1, F.length(t))
        at = F.regexp_instr(F.when(start > 0, F.concat(F.lit(""), tail)).otherwise(t), F.lit(CLOSING))
        # a match at the extra character itself counts only if it is the text's start or the place asked for
        body = F.when((at > 0) & ((at > 1) | (head == start)), strip(F.substring(t, F.lit(1), head + at - 1)))
        return F.when(F.length(body) > 0, body).otherwise(t)

    return _let(strip(F.coalesce(text, F.lit(""))), cut)


def size_windows(text: Column, size: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Windows of size characters that overlap, up to the one that reaches the end."""
    step = size - overlap
    last = F.ceil((F.length(text) - overlap) / F.lit(step)).cast("int") - 1
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(
        F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size)))
    )


def paragraph_blocks(text: Column, size: int = MAX_CHARS) -> Column:
    """Paragraphs packed greedily up to size characters; a longer paragraph is cut into windows on its own."""
    paragraphs = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n+"), strip), lambda p: F.length(p) > 0)

    def pack(acc: Column, p: Column) -> Column:
        done, open_ = acc["done"], acc["open"]
        flushed = F.when(F.length(open_) > 0, F.concat(done, F.array(open_))).otherwise(done)
        fits = F.length(open_) + F.length(p) + 2 <= size
        grown = F.when(F.length(open_) > 0, F.concat(open_, F.lit("\n\n"), p)).otherwise(p)
        return (
            F.when(F.length(p) > size, F.struct(F.concat(flushed, size_windows(p)).alias("done"), F.lit("").alias("open")))
            .when(fits, F.struct(done.alias("done"), grown.alias("open")))
            .otherwise(F.struct(flushed.alias("done"), p.alias("open")))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    packed = lambda ps: F.aggregate(
        ps, start, pack, lambda a: F.when(F.length(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
    )
    return F.when(F.length(text) <= size, F.array(text)).otherwise(
        _let(paragraphs, lambda ps: F.when(F.size(ps) <= 1, size_windows(text)).otherwise(packed(ps)))
    )


def only_ceremonial(text: Column) -> Column:
    return (F.length(text) < MIN_CHARS) & text.rlike(ONLY_CEREMONIAL)


def fragments(docs: DataFrame, mode: str = "paragraphs", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """docs with one row for each fragment: document_id, fragment_id, ord, text, and the other columns of docs.

    Articles first; each is cut by paragraphs ("paragraphs") or by windows ("size") if it is too long. Pieces that are a
    closing formula alone go, but no document with text is lost.
    """
    if mode not in ("paragraphs", "size"):
        raise ValueError(f"unknown mode {mode!r}")
    inner = paragraph_blocks if mode == "paragraphs" else size_windows
    keep = [c for c in docs.columns if c not in (id_col, text_col)]
    clean = docs.select(F.col(id_col).alias("document_id"), *keep, without_closing(F.col(text_col)).alias("_clean"))
    articles = F.filter(F.transform(F.split("_clean", ARTICLE), strip), lambda t: F.length(t) > 0)
    pieces = _let(articles, lambda a: F.when(F.size(a) > 1, F.flatten(F.transform(a, lambda t: inner(t)))).otherwise(inner(F.col("_clean"))))
    useful = F.filter(F.transform(pieces, strip), lambda t: ~only_ceremonial(t) & (F.length(t) > 0))
    whole = F.when(F.length(strip(F.col("_clean"))) > 0, F.array(strip(F.col("_clean")))).otherwise(F.array().cast("array<string>"))
    found = clean.withColumn("_f", useful).withColumn("_f", F.when(F.size("_f") > 0, F.col("_f")).otherwise(whole))
    out = found.select("document_id", *keep, F.posexplode("_f").alias("ord", "text"))
    return out.withColumn("fragment_id", F.concat(F.col("document_id").cast("string"), F.lit("::frag"), F.col("ord").cast("string")))


def text_to_encode(title: Column, text: Column) -> Column:
    """The optional title header of a fragment."""
    return F.concat_ws("\n", F.nullif(title, F.lit("")), text)
