"""Bibliographic records: `.bib` text in and out, and extraction from article XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.text import printable, without_byte_mark

FIELDS = ["author", "accession", "type", "title", "journal", "citation", "year", "abstract"]


def parse_lines(lines: DataFrame, separator: str = "|") -> DataFrame:
    """``lines(path, value)`` of ``field|value`` to one row per path. Fields go by name; a separator inside a value stays."""
    at = F.instr("value", separator)
    named = lines.where(at > 0).select("path", F.lower(F.trim(F.expr(f"substring(value, 1, instr(value, '{separator}') - 1)"))).alias("field"), F.expr(f"substring(value, instr(value, '{separator}') + {len(separator)})").alias("content"))
    chosen = [F.coalesce(F.min(F.when(F.col("field") == f, without_byte_mark(F.col("content")))), F.lit("")).alias(f) for f in FIELDS]
    return named.groupBy("path").agg(*chosen)


def read_bib(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    """All `.bib` files below ``path``."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bib").text(path)
    return parse_lines(lines.select(F.col("_metadata.file_path").alias("path"), "value"), separator)


def read_bib_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Files of ``field::kind::value`` lines."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.split("value", "::", 3).alias("p"))
    return parse_lines(lines.where("size(p) = 3").select("path", F.concat(F.col("p")[0], F.lit("|"), F.col("p")[2]).alias("value")))


def read_field_files(spark: SparkSession, path: str) -> DataFrame:
    """One file per field, ``<field>/<paper>``; accessions get a leading blank and the paper's id."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = files.select(F.element_at(parts, -1).alias("path"), F.element_at(parts, -2).alias("field"), F.trim(F.regexp_replace("value", "\\s*\\n", " ")).alias("content"))
    content = F.when(F.col("field") == "accession", F.concat(F.lit(" "), "content", F.lit(" "), "path")).otherwise(F.col("content"))
    return parse_lines(named.select("path", F.concat("field", F.lit("|"), content).alias("value")))


def bib_text(record: dict[str, Column] | None = None) -> Column:
    """The eight lines of a record as one string."""
    record = record or {f: F.col(f) for f in FIELDS}
    return F.concat_ws("\n", *(F.concat(F.lit(f"{f}|"), F.coalesce(record[f], F.lit(""))) for f in FIELDS))


def write_bib(records: DataFrame, path: str) -> None:
    records.select(bib_text().alias("value")).write.text(path)


def _between(text: Column, tag: str, inner: str = ".+?") -> Column:
    return F.regexp_extract(text, f"(?s)<{tag}[^>]*>({inner})</{tag}>", 1)


def extract(xml: Column, sanitize: bool = False) -> Column:
    """Author, subject, accession, type, journal, title, abstract, citation and year of an article's XML, as a struct.

    Newlines go first and the first match of each field holds; authors and subjects are joined by commas.
    """
    x = F.regexp_replace(xml, "\\n", "")
    groups = F.array_join(F.regexp_extract_all(x, F.lit("<contrib-group[^>]*>(.+?)</contrib-group>"), F.lit(1)), "\u0001")
    name = "<surname>(.+?)</surname>\\s+<given-names>(.+?)</given-names>"
    surnames, given = (F.regexp_extract_all(groups, F.lit(name), F.lit(i)) for i in (1, 2))
    number = lambda kind: F.regexp_extract(x, f'<article-id pub-id-type="{kind}">(\\d+?)</article-id>', 1)
    volume, issue = _between(x, "volume", "\\d+"), _between(x, "issue", "\\d+")
    pages = "<fpage>(\\d+)</fpage>\\s+<lpage>(\\d+)</lpage>"
    first, last = F.regexp_extract(x, pages, 1), F.regexp_extract(x, pages, 2)
    some = lambda c, shown: F.when(c != "", shown).otherwise(F.lit(""))
    fields = {
        "author": F.array_join(F.zip_with(surnames, given, lambda s, g: F.concat_ws(" ", s, g)), ", "),
        "subject": F.array_join(F.regexp_extract_all(x, F.lit("<subject>(.+?)</subject>"), F.lit(1)), ", "),
        "accession": F.when(number("pmid") != "", F.concat(F.lit("PMID       "), number("pmid"))).when(number("pmc") != "", F.concat(F.lit("PMC       "), number("pmc"))).otherwise(F.lit("")),
        "type": F.regexp_extract(x, 'article-type="(.+?)"', 1),
        "journal": _between(x, "journal-title"),
        "title": _between(x, "article-title"),
        "abstract": _between(x, "abstract"),
        "citation": F.concat(some(volume, F.concat(F.lit("V : "), volume, F.lit(" "))), some(issue, F.concat(F.lit("("), issue, F.lit(") "))), some(first, F.concat(F.lit("pp. "), first, F.lit("-"), last))),
        "year": F.regexp_extract(x, '<pub-date pub-type=".*?">.*?<year>(\\d+)</year>\\s+</pub-date>', 1),
    }
    return F.struct(*((printable(c) if sanitize else c).alias(n) for n, c in fields.items()))


def dispatch(papers: DataFrame, field_bib: DataFrame) -> DataFrame:
    """``papers(path, xml)``: model-organism papers take their fields from ``field_bib(path, ...)``, others from their XML."""
    key = F.regexp_extract("path", "(WBPaper\\d{8})", 1)
    keyed = papers.withColumn("paper", key)
    own = keyed.where("paper <> ''").join(field_bib.withColumnRenamed("path", "paper"), "paper").select("path", *FIELDS)
    read = keyed.where("paper = '' and length(xml) > 0").select("path", extract(F.col("xml"), True).alias("b")).select("path", *(F.col(f"b.{f}") for f in FIELDS))
    return own.unionByName(read)
