"""Raw and annotated documents, lexicons and side tables as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.text import decoded_entities, encoded_entities, file_stem, normalized, parent_name, variations

_PLAIN = re.compile(r"^\w+$")


def read_raw(spark: SparkSession, path: str, kind: str, use_parent: bool = False) -> DataFrame:
    """Whole files as ``path, name, source_type, content``; the name is a file's stem or its folder."""
    glob = {"pdf": "*.pdf", "xml": "*.{xml,nxml}"}[kind]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = parent_name(F.col("path")) if use_parent else file_stem(F.col("path"))
    return files.select("path", name.alias("name"), F.lit("nxml" if kind == "xml" else "pdf").alias("source_type"), "content")


def pdf_elements(raw: DataFrame, parser: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Text elements of PDF bytes by a parser the caller brings; no PDF library is part of the engine."""
    from folium.schemas import SCHEMAS

    names = SCHEMAS["text_elements"].fieldNames()

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(p, *r) for p, c in zip(f["path"], f["content"], strict=True) for r in parser(c)]
            yield pd.DataFrame(rows, columns=["path", *names])

    return raw.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in SCHEMAS["text_elements"]))


def read_xml_text(spark: SparkSession, path: str) -> DataFrame:
    """XML files as text with white space between tags reduced."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", ">\\s+<", "> <").alias("xml"))


def framed(name, text):
    """``N#name#text``, the way a stream names its document."""
    return F.concat(F.length(name).cast("string"), F.lit("#"), name, F.lit("#"), text)


def unframed(text):
    """Name and text of a framed string."""
    size = F.regexp_extract(text, "^(\\d+)#", 1)
    n = F.when(size != "", size.cast("int"))
    start = F.length(size) + 2
    return F.struct(F.when(n.isNotNull(), F.substring(text, start, n)).alias("filename"), F.when(n.isNotNull(), F.substring(text, start + n + 1, F.length(text))).otherwise(text).alias("text"))


def list_annotated(spark: SparkSession, path: str, allowed: DataFrame | None = None, bibs: DataFrame | None = None) -> DataFrame:
    """Annotated documents ``<corpus>/<paper>/<paper>.tpcas.gz`` below ``path``: ``path, paper, corpus``.

    ``allowed(paper)`` restricts them; with ``bibs(path, ...)`` those without a record are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tpcas.gz").load(path).select("path")
    parts = F.split("path", "/")
    files = files.select("path", F.element_at(parts, -2).alias("paper"), F.element_at(parts, -3).alias("corpus"))
    if allowed is not None:
        files = files.join(allowed.select("paper").distinct(), "paper", "left_semi")
    if bibs is not None:
        files = files.join(bibs.select(F.element_at(F.split("path", "/"), -2).alias("paper")).distinct(), "paper", "left_semi")
    return files


ANNOTATION_FIELDS = ["content", "value", "term", "category", "tagtype"]


def parse_xmi(value: Column) -> Column:
    """An XMI document as ``text, annotations``; attributes are decoded, so offsets fit the text."""
    entry = '<(?:\\w+:)(\\w+)((?:\\s+[\\w:]+="[^"]*")*)\\s*/?>'
    attr = lambda x, n: F.regexp_extract(x, f'(?:^|\\s){n}="([^"]*)"', 1)
    kinds, rest = (F.regexp_extract_all(value, F.lit(entry), F.lit(i)) for i in (1, 2))
    rows = F.filter(F.zip_with(kinds, rest, lambda k, a: F.struct(k.alias("type"), a.alias("attrs"))), lambda r: r["attrs"].rlike('\\sbegin="\\d+"'))
    one = lambda r: F.struct(r["type"].alias("type"), attr(r["attrs"], "begin").cast("int").alias("begin"), attr(r["attrs"], "end").cast("int").alias("end"), *(F.nullif(decoded_entities(attr(r["attrs"], n)), F.lit("")).alias(n) for n in ANNOTATION_FIELDS))
    return F.struct(decoded_entities(F.regexp_extract(value, 'sofaString="([^"]*)"', 1)).alias("text"), F.transform(rows, one).alias("annotations"))


def xmi_text(text: Column, annotations: Column) -> Column:
    """An XMI document of a text and its annotations, the inverse of ``parse_xmi``; null fields are left out."""
    quoted = lambda n, c: F.concat(F.lit(f' {n}="'), encoded_entities(c), F.lit('"'))

    def one(r: Column, i: Column) -> Column:
        places = F.concat(F.lit(' begin="'), r["begin"].cast("string"), F.lit('" end="'), r["end"].cast("string"), F.lit('"'))
        return F.concat(F.lit("<folium:"), r["type"], F.lit(' xmi:id="'), (i + 2).cast("string"), F.lit('" sofa="1"'), places, *(F.coalesce(quoted(n, r[n]), F.lit("")) for n in ANNOTATION_FIELDS), F.lit("/>"))

    head = F.lit('<?xml version="1.0" encoding="UTF-8"?><xmi:XMI xmlns:xmi="http://www.omg.org/XMI" xmlns:cas="http:///uima/cas.ecore" xmlns:folium="http:///folium.ecore" xmi:version="2.0">')
    sofa = F.concat(F.lit('<cas:Sofa xmi:id="1" sofaNum="1" sofaID="_InitialView" mimeType="text"'), quoted("sofaString", text), F.lit("/>"))
    return F.concat(head, F.array_join(F.transform(annotations, one), ""), sofa, F.lit("</xmi:XMI>"))


def read_xmi(spark: SparkSession, path: str) -> DataFrame:
    """Stand-off annotations of XMI files: ``path, text, annotations``; gzip goes by the file's suffix."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), parse_xmi(F.col("value")).alias("x")).select("path", "x.text", "x.annotations")


def write_xmi(annotated: DataFrame, path: str, name: str = "name") -> None:
    """``name, text, annotations`` as gzipped XMI documents, a folder for each name; ``read_xmi`` reads them back."""
    annotated.select(name, xmi_text(F.col("text"), F.col("annotations")).alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", 1).partitionBy(name).text(path)


def write_annotated_parts(annotated: DataFrame, path: str, segments: int | None = None) -> None:
    """Annotated documents as Parquet, in ``segments`` parts if asked."""
    (annotated.repartition(segments) if segments else annotated).write.parquet(path)


def lexicon_rows(rows: DataFrame) -> DataFrame:
    """``term, lexicalvariations, category`` rows as ``term, category``: the term and each variation."""
    base = rows.select("term", "category")
    more = rows.select(F.explode(variations(F.coalesce("lexicalvariations", F.lit("")))).alias("term"), "category")
    return base.unionByName(more).where("term <> ''").distinct()


def read_lexicon_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Lines split at their first tab."""
    at = F.instr("value", "\t")
    return spark.read.text(path).where(at > 0).select(F.expr("substring(value, 1, instr(value, '\t') - 1)").alias("term"), F.expr("substring(value, instr(value, '\t') + 1)").alias("category"))


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Words between white space, normalised."""
    return spark.read.text(path).select(F.explode(F.split("value", "\\s+")).alias("w")).select(normalized(F.col("w")).alias("word")).where("word <> ''").distinct()


def read_jdbc(spark: SparkSession, url: str, name: str, columns: list[str], **options: str) -> DataFrame:
    """Named columns of a database table (lexicon, stop words, category edges)."""
    for x in (name, *columns):
        if not _PLAIN.match(x):
            raise ValueError(f"not a plain name: {x!r}")
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load().select(*columns)


def category_edges(rows: DataFrame) -> DataFrame:
    """``parent, child`` without the edges that hang on the root."""
    return rows.where("parent <> 'root'").select("parent", "child")


def attribute_keys(rows: DataFrame) -> DataFrame:
    """Keys of ``k=v k=v`` attribute strings, once for each mention."""
    parts = rows.where(F.col("attributes").rlike("=")).select(F.explode(F.split(F.lower("attributes"), "[ \\n\\t]")).alias("part"))
    return parts.where(F.col("part").contains("=")).select(F.trim(F.split("part", "=")[0]).alias("key"))


def read_literature_map(spark: SparkSession, path: str) -> DataFrame:
    """User literature: ``file, corpus`` from tab-separated lines."""
    return read_lexicon_tsv(spark, path).toDF("file", "corpus")


def upload_corpora(paths: DataFrame, literature: DataFrame) -> DataFrame:
    """Corpora of uploaded files: ``path`` below ``useruploads/<user>/<file>`` looked up in the literature map."""
    found = F.regexp_extract("path", "useruploads/([^/]+)/(.*)", 2)
    return paths.withColumn("user", F.regexp_extract("path", "useruploads/([^/]+)/", 1)).withColumn("file", found).where("file <> ''").join(literature, "file").select("path", "user", "corpus")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Text rows of numbers as ``row, values``, numbered from 0 through files by name; sparse rows ``i v i v`` are told apart by ``sparse_matrix``."""
    from folium.operators.index import with_ids

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    values = F.transform(F.filter(F.split(F.trim("value"), "\\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    return with_ids(lines, ["_f", "_b", "_m"]).select(F.col("id").alias("row"), values.alias("values"))


def write_matrix(rows: DataFrame, path: str) -> None:
    """``row, values`` as lines of numbers in the order of rows; a range of rows is a file."""
    rows.repartitionByRange("row").sortWithinPartitions("row").select(F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias("value")).write.text(path)


def sparse_matrix(rows: DataFrame) -> DataFrame:
    """``row, values`` of alternating index and value to ``row, col, value``."""
    pairs = F.transform(F.sequence(F.lit(0), F.expr("cast(size(values) div 2 as int) - 1")), lambda k: F.struct(F.get(F.col("values"), 2 * k).cast("long").alias("col"), F.get(F.col("values"), 2 * k + 1).alias("value")))
    return rows.where("size(values) >= 2").select("row", F.explode(pairs).alias("p")).select("row", "p.col", "p.value")


def write_token_counts(counts: DataFrame, path: str) -> None:
    """``term<tab>count`` lines."""
    counts.select("term", "count").write.option("sep", "\t").csv(path)
