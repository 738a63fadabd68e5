"""Quality rules on lines that many documents of a host share, and the per-document base rules. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import let, staged, words
from corvina.shared import BROADCAST_ROWS

#: Fixed value: the characters that count as symbols.
SYMBOLS = "[^#*$%&|<>]+"
#: A frequent line is looked up under one of so many salts, so that a line of a third of all documents is dealt out.
SALTS = 64
#: Up to so many repeated windows a text, membership is a scan over them; beyond, positions are found by sorting.
SCAN_LIMIT = 256


def _covered(positions: Column) -> Column:
    """Words that windows of three at these ascending starts cover."""
    gaps = F.transform(
        positions, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1) - p, F.lit(3)))
    )
    return F.aggregate(gaps, F.lit(0).cast("int"), lambda a, x: a + x.cast("int"))


def repeated_window_words(tokens: Column) -> Column:
    """Words inside 3-word windows that are found twice or more in the text, first one included."""

    def by_scan(hashes: Column, repeated: Column) -> Column:
        found = F.filter(
            F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(repeated, F.get(hashes, i))
        )
        return let(found, _covered)

    def by_sort(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])),
            )
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), _covered)

        return let(pairs, positions)

    def counted(hashes: Column) -> Column:
        repeated = let(
            F.sort_array(hashes),
            lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))),
        )
        return let(
            repeated,
            lambda r: F.when(F.size(r) == 0, F.lit(0))
            .when(F.size(r) <= SCAN_LIMIT, by_scan(hashes, r))
            .otherwise(by_sort(hashes)),
        )

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(tokens, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), counted)))


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def normalised_line(line: Column) -> Column:
    """Lower case, outer white space off, inner white space as one space, digits as 0."""
    folded = F.regexp_replace(F.lower(line), "[0-9]", "0")
    return F.btrim(F.regexp_replace(folded, "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))


def base_rules(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """One row for each row of df: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and more columns.

    more may name the text as text (null stays null) and the columns of df.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    src = df.withColumns({"id": F.col(id_col), "text": F.col(text_col).cast("string")})
    lines = _worded_lines(F.col("text"))
    counted = let(
        words(F.col("text")),
        lambda w: F.struct(F.size(w).alias("n"), repeated_window_words(w).alias("r")),
    )
    out = src.select(
        "id",
        counted.alias("w"),
        F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.struct(F.lit(1).alias("_"), *more).alias("more"),
    )
    n, r = F.col("w.n").cast("long"), F.col("w.r").cast("long")
    return out.select(
        "id",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        r.alias("n_repeat_words"),
        ((n < 50) | (100 * r > 50 * n)).alias("base_failed"),
        "more.*",
    ).drop("_")


def row_table(df: DataFrame, id_col: str, text_col: str, host_col: str, distinct: str = "documents", with_text: bool = False) -> DataFrame:
    """The base rules of each row of df with its number r, host, counted, lines (line, n) with a word, and text if asked for.

    line is the hash of a normalised line and n its words. counted is what is counted once a line and host: the id (of rows
    without one the text), or the text ("texts"). r is a number only while the table stays written: stage it before use.
    """
    lines = F.transform(
        _worded_lines(F.col("text")),
        lambda x: F.struct(F.xxhash64(normalised_line(x)).alias("line"), F.size(words(x)).alias("n")),
    )
    text = F.xxhash64("text")
    counted = text if distinct == "texts" else F.when(F.col("id").isNull(), text).otherwise(F.xxhash64("id"))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    more = [host.alias("host"), counted.alias("counted"), lines.alias("lines"), *([F.col("text")] if with_text else [])]
    return base_rules(df, id_col, text_col, *more).withColumn("r", F.monotonically_increasing_id())


def frequent_lines(rows: DataFrame, line_share: float, min_docs: int, many_docs: int | None = None) -> DataFrame:
    """(host, line, n_docs, salts) of lines in more than min_docs different documents of a host and more than line_share of
    its different documents, or in more than many_docs; salts: a bit for each salt that its rows have."""
    each = rows.select("host", "counted", _salt().alias("salt"), F.explode("lines.line").alias("line"))
    once = each.groupBy("host", "line", "counted").agg(F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    counts = once.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.bit_or("salts").alias("salts"))
    hosts = rows.filter(F.size("lines") > 0).groupBy("host").agg(F.count_distinct("counted").alias("host_docs"))
    often = F.col("n_docs") > line_share * F.col("host_docs")
    if many_docs is not None:
        often = often | (F.col("n_docs") > many_docs)
    return counts.filter(F.col("n_docs") > min_docs).join(hosts, "host").filter(often).select("host", "line", "n_docs", "salts")


def _salt() -> Column:
    return F.pmod(F.xxhash64("r"), F.lit(SALTS)).cast("int")


def line_verdicts(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """For each row r with a frequent line: n_lines_removed, n_words_removed, removed (hashes)."""
    each = rows.select("r", "host", _salt().alias("salt"), F.explode("lines").alias("x")).select("r", "host", "salt", "x.*")
    if frequent.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hit = each.join(F.broadcast(frequent.select("host", "line")), ["host", "line"])
    else:
        own = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("salts", k) == 1)
        hit = each.join(frequent.select("host", "line", F.explode(own).alias("salt")), ["host", "line", "salt"])
    return hit.groupBy("r", "line").agg(F.sum("n").alias("n")).groupBy("r").agg(
        F.count("*").alias("n_lines_removed"),
        F.sum("n").alias("n_words_removed"),
        F.collect_list("line").alias("removed"),
    )


def line_frequency_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    line_share: float = 0.05,
    min_docs: int = 20,
    max_removed: float = 0.5,
    with_text: bool = False,
    distinct: str = "documents",
    many_docs: int | None = None,
) -> DataFrame:
    """Cross-document line frequency: drop lines that too many documents of a host share, reject depleted documents.

    A line is taken without case, digits and outer or repeated white space, as a 64-bit hash. It goes if it is in more than
    min_docs different documents of its host and in more than line_share of them (or in more than many_docs, if that is
    given). A document is rejected if a base rule
    fails (under 50 words, or over half of its words in repeated 3-word windows) or if over max_removed of its words went.
    The lists of removed hashes stay with the document, so they are as long as its own lines at most. distinct="texts" counts
    rows with equal texts as one document, so that copies don't make their own lines frequent.

    Edge cases: a null text is an empty one (n_words 0, rejected); a null host is a host of its own; rows that share an id
    are one document where documents are counted, but each is judged by its own lines; rows with a null id are judged like
    any other, and counted by their text; an empty table gives no rows; columns other than the three named ones are ignored.
    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines_removed,
    n_words_removed, kept; with_text adds text without the removed lines, under the name cleaned_text.
    """
    rows = staged(row_table(df, id_col, text_col, host_col, distinct, with_text), "rows")
    verdicts = line_verdicts(rows, staged(frequent_lines(rows, line_share, min_docs, many_docs), "frequent"))
    gone, left = F.coalesce("n_words_removed", F.lit(0)), F.col("n_words")
    # a line is looked for in the list of the document's own removed lines
    left_lines = F.filter(
        F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~F.array_contains("removed", F.xxhash64(normalised_line(x)))
    )
    cleaned = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left_lines, "\n"))
    return rows.drop("lines").join(verdicts, "r", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.coalesce("n_lines_removed", F.lit(0)).cast("long").alias("n_lines_removed"),
        gone.cast("long").alias("n_words_removed"),
        (~F.col("base_failed") & (gone <= max_removed * left)).alias("kept"),
        *([cleaned.alias("cleaned_text")] if with_text else []),
    )
