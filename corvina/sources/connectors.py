"""Source connectors: raw files of each kind to the common document shape, and the sinks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions.text import fix_mojibake, spanish_date_to_iso, strip
from corvina.shared import numbered, small, staged

DOCUMENT = (
    "id string, fuente string, tipo string, identificador string, titulo string, fecha string, texto string, "
    "url_original string, metadata string"
)
# The relations that link labels begin with, longer ones before their own beginnings.
RELATIONS = (
    "Modificado por", "Modificado transitoriamente por", "Adicionado por", "Sustituido por", "Derogado parcialmente", "Derogado por",
    "Deroga parcialmente", "Deroga", "Reglamenta parcialmente", "Reglamenta", "Adiciona",
)
# Minimum lengths of texts by kind of source.
MIN_LENGTH = {"html": 200, "catalogue": 80, "api": 100, "markdown": 40}


def documents_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw corpus files: JSON objects or arrays in the document shape; files whose names begin with _ are skipped by Spark."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def court_hits(spark: SparkSession, path: str) -> DataFrame:
    """API answers by year: data.hits.hits[], empty summaries dropped."""
    schema = (
        "data struct<hits: struct<hits: array<struct<_id: string, _source: struct<prov_sentencia: string, prov_sintesis: string, "
        "prov_f_sentencia: string, prov_tema: string, prov_tipo: string, rutahtml: string>>>>>"
    )
    hit = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data.hits.hits").alias("h"))
    text = strip(fix_mojibake(F.coalesce("h._source.prov_sintesis", F.lit(""))))
    out = hit.select(
        F.concat(F.lit("corte_constitucional:"), F.col("h._source.prov_sentencia")).alias("id"),
        F.lit("corte_constitucional").alias("fuente"),
        F.lit("sentencia").alias("tipo"),
        F.col("h._source.prov_sentencia").alias("identificador"),
        fix_mojibake(F.col("h._source.prov_tema")).alias("titulo"),
        F.col("h._source.prov_f_sentencia").alias("fecha"),
        text.alias("texto"),
        F.col("h._source.rutahtml").alias("url_original"),
    )
    return out.filter((F.col("texto") != "") & (F.lower("texto") != "sin información")).dropDuplicates(["id"])


def superintendence_hits(spark: SparkSession, path: str) -> DataFrame:
    """API answers with nested arrays: hits.hits[]._source; short texts dropped, one row for each id."""
    schema = (
        "hits struct<hits: array<struct<_id: string, _source: struct<documento_principal: struct<contenido_archivo: string>, "
        "descriptores: array<struct<nombre: string>>, fecha: string, titulo: string>>>>"
    )
    hit = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("hits.hits").alias("h"))
    names = F.filter(F.transform("h._source.descriptores", lambda d: d["nombre"]), lambda x: x.isNotNull())
    return (
        hit.select(
            F.concat(F.lit("supersociedades:"), F.col("h._id")).alias("id"),
            F.lit("supersociedades").alias("fuente"),
            F.col("h._source.titulo").alias("titulo"),
            F.col("h._source.fecha").alias("fecha"),
            strip(F.coalesce("h._source.documento_principal.contenido_archivo", F.lit(""))).alias("texto"),
            names.alias("descriptores"),
        )
        .filter(F.length("texto") >= MIN_LENGTH["api"])
        .dropDuplicates(["id"])
    )


def commerce_hits(spark: SparkSession, path: str, texts: DataFrame) -> DataFrame:
    """API answers whose texts are in PDF files: hits.hits[]._source joined to texts (file, texto) that were extracted before.

    Hits without a file, and texts that are missing or short, go.
    """
    schema = (
        "hits struct<hits: array<struct<_id: string, _source: struct<informacion: struct<numero_expediente: string, ano_expediente: string, "
        "tipo_providencia: string, tipo_proceso: string, fecha_providencia: string>, documento_resumen: struct<url_documento_pdf_s3: string>, "
        "tesauro: array<struct<descriptor: struct<nombre: string>>>>>>>"
    )
    hit = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("hits.hits").alias("h"))
    info = lambda name: F.col(f"h._source.informacion.{name}")
    number = F.coalesce(info("numero_expediente"), F.lit(""))
    ident = F.when(number != "", F.concat(F.coalesce(info("ano_expediente"), F.lit("")), F.lit("-"), number)).otherwise(F.col("h._id"))
    names = F.filter(F.transform("h._source.tesauro", lambda t: t["descriptor"]["nombre"]), lambda x: F.coalesce(x, F.lit("")) != "")
    rows = hit.select(
        F.concat(F.lit("sic:"), F.col("h._id")).alias("id"),
        F.lit("sic").alias("fuente"),
        F.lit("sentencia").alias("tipo"),
        ident.alias("identificador"),
        F.concat_ws(" ", F.lit("SIC"), F.coalesce(info("tipo_providencia"), F.lit("Providencia")), ident).alias("titulo"),
        info("fecha_providencia").alias("fecha"),
        F.lit("https://relatoria.sic.gov.co/#/").alias("url_original"),
        F.struct(info("tipo_proceso").alias("tipo_proceso"), info("tipo_providencia").alias("tipo_providencia"), names.alias("tesauro")).alias("metadata"),
        F.col("h._source.documento_resumen.url_documento_pdf_s3").alias("file"),
    )
    known = texts.select("file", strip(F.col("texto")).alias("texto")).filter(F.length("texto") >= MIN_LENGTH["api"])
    return rows.join(known, "file").drop("file")


def markdown_laws(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with a YAML head between --- lines; the head's plain keys become columns."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = strip(F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", ""))
    key = lambda name: F.nullif(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1), r"^[\"']|[\"']$", ""), F.lit(""))
    kinds = F.create_map(*(F.lit(x) for kv in {"ley": "ley", "decreto": "decreto", "resolucion": "resolucion", "acto_legislativo": "ley"}.items() for x in kv))
    ident = F.coalesce(key("identifier"), F.regexp_replace("file", r"\.[^.]*$", ""))
    return raw.select(
        F.concat(F.lit("legalize_co_github:"), ident).alias("id"),
        F.lit("legalize_co_github").alias("fuente"),
        F.coalesce(kinds[F.lower(key("rank"))], F.lit("ley")).alias("tipo"),
        ident.alias("identificador"),
        key("title").alias("titulo"),
        key("publication_date").alias("fecha"),
        body.alias("texto"),
        key("source").alias("url_original"),
    ).filter(F.length("texto") >= MIN_LENGTH["markdown"])


class _Text(HTMLParser):
    """Visible text with line breaks at blocks, and links with their labels."""

    BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 table ul ol section article title".split())
    HIDDEN = frozenset(("script", "style", "noscript", "template"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.title = ""
        self._hidden, self._href, self._label, self._in_title = 0, None, [], False

    def handle_starttag(self, tag, attrs):
        self._hidden += tag in self.HIDDEN
        self._in_title |= tag == "title"
        if tag in self.BLOCKS:
            self.out.append("\n")
        if tag == "a":
            self._href, self._label = dict(attrs).get("href"), []

    def handle_endtag(self, tag):
        self._hidden -= tag in self.HIDDEN and self._hidden > 0
        if tag == "title":
            self._in_title = False
        if tag == "a" and self._href:
            self.links.append((self._href, " ".join("".join(self._label).split())))
            self._href = None
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self._hidden:
            return
        if self._in_title:
            self.title += data
            return
        self.out.append(data)
        if self._href is not None:
            self._label.append(data)

    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def html_documents(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = MIN_LENGTH["html"]) -> DataFrame:
    """(id, titulo, texto, fecha, enlaces) of pages by a real parser, in Arrow batches; texts under least characters go."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, html in zip(b["id"], b["html"]):
                p = _Text()
                p.feed(html or "")
                p.close()
                rows.append((key, " ".join(p.title.split()), p.text(), [{"href": h, "label": t} for h, t in p.links]))
            yield pd.DataFrame(rows, columns=["id", "titulo", "texto", "enlaces"])

    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    out = src.mapInPandas(parse, "id long, titulo string, texto string, enlaces array<struct<href: string, label: string>>")
    out = out.filter(F.length("texto") >= least)
    return out.withColumn("fecha", F.nullif(spanish_date_to_iso(F.col("texto")), F.col("texto")))


def relation_edges(parsed: DataFrame) -> DataFrame:
    """(src, dst, tipo): links to other norms (…?i=123) with the relation that their label begins with."""
    link = parsed.select(F.col("id").alias("src"), F.explode("enlaces").alias("l"))
    label = fix_mojibake(F.col("l.label"))
    kind = F.regexp_extract(label, r"^(" + "|".join(RELATIONS) + r")", 1)
    return link.select(
        "src", F.regexp_extract("l.href", r"[?&]i=(\d+)", 1).alias("dst"), F.when(kind == "", "relacionado").otherwise(kind).alias("tipo")
    ).filter("dst <> ''")


def latin_pages(spark: SparkSession, path: str) -> DataFrame:
    """ISO-8859-1 pages as (path, html)."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("html"))


def catalogue_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The different links to documents of catalogue pages, sorted."""
    href = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(r'href="(docs/[^"#]+\.htm)'), F.lit(1)))
    return pages.select(href.alias("link")).distinct().orderBy("link")


def labelled_records(
    pages: DataFrame, marker: str, labels: dict[str, str], full: str, summary: str, html_col: str = "html", keep: list[str] | None = None
) -> DataFrame:
    """Pages split at a marker into records; labelled cells become columns; texto is the longer of full text and summary."""
    rec = pages.select(*(keep or []), F.posexplode(F.split(html_col, marker)).alias("pos", "rec")).filter("pos > 0")
    cells = {name: strip(F.regexp_replace(F.regexp_extract("rec", rf"(?s){label}\s*</td>\s*<td[^>]*>(.*?)</td>", 1), r"<[^>]+>", " ")) for name, label in labels.items()}
    out = rec.select(*(keep or []), "pos", *(c.alias(n) for n, c in cells.items()))
    return out.withColumn("texto", F.when(F.length(full) >= F.length(summary), F.col(full)).otherwise(F.col(summary)))


# The first bytes (in hex) of sound and film files; bytes of a sample.
SOUND = ("494433", "FFFB", "FFF3", "FFF2", "52494646", "000000")
SAMPLE = 8192


def binary_kind(content: Column) -> Column:
    """What a file is by its first bytes: zip (docx), pdf, audio, or else text or unknown.

    Text has under 1 % control bytes in each of three places of 8,192 bytes: start, middle and end.
    """
    n = F.octet_length(content).cast("int")
    hexed = F.hex(F.substring(content, 1, 4))
    mixed = F.lit(False)
    for at in (F.lit(0), F.floor(n / 2), F.greatest(F.lit(0), n - SAMPLE)):
        seen = F.decode(F.substring(content, at.cast("int") + 1, F.lit(SAMPLE)), "ISO-8859-1")
        control = F.length(seen) - F.length(F.regexp_replace(seen, r"[\x00-\x08\x0E-\x1F]", ""))
        mixed = mixed | (control * 100 >= F.greatest(F.length(seen), F.lit(1)))
    kinds = F.when(F.startswith(hexed, F.lit("504B")), "zip").when(hexed == "25504446", "pdf")
    for head in SOUND:
        kinds = kinds.when(F.startswith(hexed, F.lit(head)), "audio")
    return kinds.when((n > 0) & ~mixed, "text").otherwise("unknown")


def title_identifier(title: Column, stem: Column) -> Column:
    found = F.regexp_extract(title, r"[A-Z]{1,3}\d{3,5}-\d{4}", 0)
    return F.when(found != "", found).otherwise(stem)


# Fixed value: what questions begin with.
PHRASINGS = (
    "puedo", "me pueden", "que pasa si", "que hago si", "como hago para", "cuanto me", "cuando me", "tengo derecho a", "es legal que",
    "donde puedo", "me toca", "estoy obligado a",
)


def harvested(
    suggestions: DataFrame, seeds: DataFrame, phrasings: tuple[str, ...] = PHRASINGS, junk: str | None = None, requests: int = 900, deepen: int = 120, least_words: int = 4
) -> DataFrame:
    """(query, seed, level): the useful suggestions for seeds, and for what they brought.

    suggestions: (asked, pos, suggestion), what an engine suggests for a text; seeds: (seed, pos), a list written by hand.
    Each seed is asked for bare and behind each phrasing, in order, up to requests in all; then the first deepen queries that
    were found, as long as requests are left. A suggestion counts once, where it is met first, lower-cased, if it has
    least_words words and junk doesn't match it.
    """
    shapes = F.posexplode(F.array(F.lit("{}"), *(F.lit(f"{p} {{}}") for p in phrasings))).alias("k", "shape")
    first = seeds.select("seed", F.col("pos").alias("at"), shapes).withColumn("asked", F.replace("shape", F.lit("{}"), F.col("seed")))
    first = numbered(first.select("at", "k", "seed", "asked"), ["at", "k", "seed"], "request").filter(F.col("request") <= requests)
    clean = F.lower(strip(F.col("suggestion")))
    useful = F.size(F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")) >= least_words
    answers = suggestions.select("asked", "pos", clean.alias("query")).filter(useful if not junk else useful & ~clean.rlike(junk))

    def met(asked: DataFrame, level: int) -> DataFrame:
        found = small(asked.select("asked", "seed", "request")).join(answers, "asked")
        return found.groupBy("query").agg(F.min(F.struct("request", "pos", "seed")).alias("m")).select("query", "m.seed", F.lit(level).alias("level"), "m.request", "m.pos")

    zero = staged(met(first, 0), "harvest")
    left = max(0, requests - first.count())
    head = zero.orderBy("request", "pos", "query").limit(min(deepen, left))
    more = numbered(head.select("request", "pos", "query", "seed").withColumnRenamed("request", "before"), ["before", "pos", "query"], "request")
    one = met(more.withColumnRenamed("query", "asked"), 1).join(zero.select("query"), "query", "left_anti")
    return zero.unionByName(one).select("query", "seed", "level")


def imported_vectors(vectors: DataFrame, fragments: DataFrame, id_col: str) -> DataFrame:
    """Vectors that have a text; none with a text may lack a vector."""
    return vectors.join(fragments, id_col)


def write_collection(df: DataFrame, path: str, by: str = "fuente", writers: int = 16) -> None:
    """The vector collection, partitioned by source, so that a source filter prunes files; a source is written by up to writers tasks."""
    salt = F.pmod(F.spark_partition_id(), F.lit(writers))
    df.repartition(F.col(by), salt).write.mode("overwrite").partitionBy(by).parquet(path)


def write_validity(table: DataFrame, path: str) -> DataFrame:
    """The validity table and, beside it, its histogram by state."""
    table.write.mode("overwrite").parquet(f"{path}/table")
    histogram = table.groupBy("estado").count()
    histogram.write.mode("overwrite").json(f"{path}/manifest")
    return histogram


def append_pending(fragments: DataFrame, path: str, key: str) -> int:
    """Append what the table at path does not have; how many rows it has then. Safe to run again after a failure."""
    spark = fragments.sparkSession
    done = spark.read.parquet(path).select(key)
    fragments.join(done, key, "left_anti").write.mode("append").parquet(path)
    return spark.read.parquet(path).count()


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def guarded_catalogue(spark: SparkSession, path: str, least: int = 50_000) -> DataFrame:
    """The official catalogue; too few rows mean a broken download."""
    df = spark.read.schema("tipo string, n_mero string, a_o string, vigencia string").option("multiLine", True).json(path)
    if df.limit(least).count() < least:
        raise ValueError(f"the catalogue has fewer than {least} rows")
    return df
