"""Texts out of binary files: what a file is by its bytes, Word documents, texts of two encodings; one file of each stem."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvina.sources.connectors import binary_kind

#: Characters of a text at most (a longer one is refused whole), and the name space of a Word document.
MOST_CHARS = 2_000_000
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Bytes that the XML of a document may unpack to: a text of MOST_CHARS has less, so what has more is refused either way.
MOST_XML = 256 << 20
#: Which of several files of one stem is taken: the first of these extensions, then the first name.
PREFERRED = ("docx", "txt", "pdf")


def docx_text(content: bytes) -> str | None:
    """The paragraphs of a document's body that aren't blank, joined by line ends; None if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as f:
            raw = f.read(MOST_XML + 1)
        if len(raw) > MOST_XML:
            return None
        body = ElementTree.fromstring(raw).find(f"{WORD}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, EOFError, RuntimeError, NotImplementedError, ValueError):
        return None
    if body is None:
        return None
    marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n", f"{WORD}noBreakHyphen": "-"}
    lines = []
    for p in body.findall(f"{WORD}p"):
        runs = [r for child in p for r in ([child] if child.tag == f"{WORD}r" else child.findall(f"{WORD}r") if child.tag == f"{WORD}hyperlink" else [])]
        line = "".join((x.text or "") if x.tag == f"{WORD}t" else marks.get(x.tag, "") for r in runs for x in r)
        if line.strip():
            lines.append(line)
    return "\n".join(lines)


def _docx(content: Column) -> Column:
    def read(content: pd.Series) -> pd.Series:
        return content.map(lambda c: None if c is None else docx_text(bytes(c)))

    return F.pandas_udf(read, StringType())(content)


def file_text(content: Column, most: int = MOST_CHARS) -> Column:
    """The text of a Word document, or of a file of kind text (UTF-8 if it is valid, else Latin-1); null for other kinds, for what
    can't be read, and for texts of more than most characters."""
    kind, utf8 = binary_kind(content), content.cast("string")
    text = F.when(kind == "zip", _docx(F.when(kind == "zip", content)))
    text = text.when(kind == "text", F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1")))
    return F.when(F.length(text) <= most, text)


def one_per_stem(files: DataFrame, path_col: str = "path", preferred: tuple[str, ...] = PREFERRED) -> DataFrame:
    """One row for each file name without its extension: the preferred extension, of several the first name."""
    end = F.lower(F.regexp_extract(path_col, r"\.([^./]*)$", 1))
    place = F.array_position(F.array(*map(F.lit, preferred)), end)
    order = F.struct(F.when(place == 0, F.lit(len(preferred) + 1)).otherwise(place).alias("p"), F.col(path_col).alias("n"))
    keep = F.struct(*files.columns)
    rows = files.groupBy(F.regexp_replace(path_col, r"\.[^./]*$", "").alias("stem")).agg(F.min_by(keep, order).alias("row"))
    return rows.select("stem", "row.*")


def binary_documents(spark: SparkSession, path: str, glob: str | None = None, least: int = 1) -> DataFrame:
    """(stem, path, kind, texto) of the files under path, one for each stem; files without a text of least characters go."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return documents_of(files.select("path", "content"), least)


def documents_of(files: DataFrame, least: int = 1) -> DataFrame:
    """As binary_documents(), of a table (path, content). A stem is judged by its files that have a text."""
    texts = files.select("path", binary_kind(F.col("content")).alias("kind"), file_text(F.col("content")).alias("texto"))
    return one_per_stem(texts.filter(F.length("texto") >= least))
