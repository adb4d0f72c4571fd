"""WARC writing, reading and transaction assembly.

Every capture becomes three records, a request, a response (or a revisit of an equal payload) and metadata, tied by
WARC-Concurrent-To; files are plain WARC 1.1 in gzip, written and read through Spark. Assembly joins the records of a
capture by identifiers, wherever they lie, into one nested row.

Of captures with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest ``page_id`` is a response,
the others are revisits that refer to it. Groups of equal payloads are reduced to one row before they meet the pages,
and pages are dealt by digest and share, so a common page is no hot key.

Defined results: null html reads as empty and null url as an empty target; a null ``page_id`` is smaller than any other; of
repeated rows with the same ``page_id`` and html one is the response; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folium.llm._io import new_folder, text_column
from folium.session import ship

MIN_REVISIT = 1000
SHARES = 32
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *parts))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cuts[0], F.lit("-"), cuts[1], F.lit("-4"), cuts[2], F.lit("-8"), cuts[3], F.lit("-"), cuts[4], F.lit(">"))


def _header(kind: Column | str, identifier: Column, block: Column, fields: list[tuple[str, Column]]) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    # a null field is left out
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), identifier), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block)


def records(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to ``value string``: three WARC records each, without their last two line ends."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text_column("html").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("page_id"), F.lit(SHARES)))
    first = F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("k"), F.col("url")))
    equal = rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    equal = equal.select("digest", F.nullif(F.col("first.k"), F.lit(-(2**63))).alias("first_id"), F.col("first.url").alias("first_url"), F.explode(F.array(*(F.lit(i).cast("long") for i in range(SHARES)))).alias("share"), F.lit(True).alias("grouped"))
    joined = rows.join(equal, ["digest", "share"], "left")
    order = Window.partitionBy("digest", "share", "page_id", "url").orderBy("bytes")
    joined = joined.withColumn("turn", F.row_number().over(order))
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("url") == F.col("first_url")) & (F.col("turn") == 1)
    revisit = F.coalesce(F.col("grouped"), F.lit(False)) & ~is_first
    shown = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    target = F.translate(F.col("url"), "\r\n", "  ")
    name = lambda kind, page, url, turn: _uuid(F.lit(kind), page, url, F.col("digest"), turn)
    turn = F.col("turn").cast("string")
    own = name("response", shown, F.col("url"), turn)
    refers = F.when(revisit, name("response", F.coalesce(F.col("first_id").cast("string"), F.lit("-")), F.col("first_url"), F.lit("1")))
    concurrent = ("WARC-Concurrent-To", own)
    uri = ("WARC-Target-URI", target)
    path = F.coalesce(F.nullif(F.regexp_extract(target, r"^[a-z]+://[^/]*(/[^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(target, r"^[a-z]+://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\nUser-Agent: folium\r\n\r\n"))
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    answer = F.when(revisit, status).otherwise(F.concat(status, F.col("html")))
    facts = F.concat(F.lit("page-id: "), shown, F.lit("\r\nfetched-bytes: "), F.col("bytes").cast("string"), F.lit("\r\n"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.lit("application/http; msgtype=")
    three = F.array(
        _header("request", name("request", shown, F.col("url"), turn), asked, [uri, concurrent, ("Content-Type", F.concat(http, F.lit("request")))]),
        _header(
            F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            own,
            answer,
            [uri, digest, ("WARC-Refers-To", refers), ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.concat(http, F.lit("response")))],
        ),
        _header("metadata", name("metadata", shown, F.col("url"), turn), facts, [uri, concurrent, ("Content-Type", F.lit("application/warc-fields"))]),
    )
    return joined.select(F.explode(three).alias("value"))


def write_archives(pages: DataFrame, path: str | None = None, records_per_file: int = 6000, bytes_per_file: int = 1 << 28) -> str:
    """Write ``pages`` as gzipped WARC files of at most ``records_per_file`` records, fewer where pages are large on average
    (about ``bytes_per_file`` before compression, as a file is read back whole); returns their folder."""
    path = path or new_folder(pages.sparkSession, "warc")
    mean = pages.agg(F.avg(F.octet_length(text_column("html")))).first()[0] or 0
    limit = max(3, min(records_per_file, int(3 * bytes_per_file / (mean + 1500))))
    (records(pages).write.option("compression", "gzip").option("lineSep", _END).option("maxRecordsPerFile", limit).text(path))
    return path


def parse(stream) -> list[tuple[dict[str, str], bytes]]:
    """Records of an open binary WARC stream, by content length."""
    out = []
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8").partition(":")
            fields[key.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("a record is cut short")
        out.append((fields, block))
    return out


_RECORD = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("declared", pa.string()), ("head", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_RECORD_SQL = "record_id string, kind string, concurrent_to string, refers_to string, url string, declared string, head string, payload binary, payload_bytes long, payload_digest string"


def _parsed(with_payload: bool):
    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for fields, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data.as_py())))):
                    kind, head, payload = fields["warc-type"], block, None
                    if kind in ("response", "request", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                    known = kind == "response"
                    rows.append((fields["warc-record-id"], kind, fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-payload-digest"), head.decode("utf-8"), payload if known and with_payload else None, len(payload) if known else None, hashlib.sha1(payload).hexdigest() if known else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 10, _RECORD.types, strict=True)], schema=_RECORD)

    return run


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """All records of a folder of gzipped WARC files; payload digests are computed from what is stored."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parsed(payload), _RECORD_SQL)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, url, kind, refers_to, request, response, metadata``.

    A revisit's response carries digest and length of the record it refers to.
    """
    answers = found.where("kind in ('response', 'revisit')")
    asked = found.where("kind = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "head").alias("request"))
    facts = found.where("kind = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "head").alias("metadata"))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '(?m)^page-id: ([0-9-]+)', 1) AS bigint)")
    one = answers.join(asked, "record_id", "left").join(facts, "record_id", "left").withColumn("page_id", page("metadata.head"))
    first = one.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_to_page"), F.col("payload_bytes").alias("bytes2"), F.col("payload_digest").alias("digest2"))
    # a response refers to nothing: a key of its own, which no record has, keeps such rows from meeting in one task
    whole = one.withColumn("asked", F.coalesce("refers_to", F.concat(F.lit("-"), "record_id"))).join(first.withColumnRenamed("refers_to", "asked"), "asked", "left")
    response = F.struct("declared", "head", "payload", F.coalesce("payload_bytes", "bytes2").alias("payload_bytes"), F.coalesce("payload_digest", "digest2").alias("payload_digest"))
    return whole.select("record_id", "page_id", "url", "kind", "refers_to", "refers_to_page", "request", response.alias("response"), "metadata")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS first_id FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""
