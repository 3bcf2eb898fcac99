"""WARC archives of captures: writing, reading, and assembling transactions.

A capture is three records: the request, the response (or a revisit, without payload), and
metadata. Request and metadata name the response through WARC-Concurrent-To. Archives are written
by Spark's text writer, whose line separator is the two line ends that close a record, so they
reach any file system that Spark can write; they are compressed by the gzip codec and are read back as binary
files. A file holds the records of a bounded number of captures.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stage

MIN_REVISIT, CAPTURES_A_FILE = 1000, 2000
# The line end and the media types of the format.
END = "\r\n"
HTTP_RESPONSE, HTTP_REQUEST, FIELDS = "application/http; msgtype=response", "application/http; msgtype=request", "application/warc-fields"
RECORDS = "type string, record_id string, concurrent_to string, refers_to string, uri string, payload_digest string, http_status string, payload binary, fields map<string,string>"


def _octets(c: Column) -> Column:
    return F.octet_length(c).cast("string")


def _record(kind: str, record_id: Column, uri: Column, media: str, block: Column, *more: tuple[str, Column]) -> Column:
    """One record without the two line ends that close it. Headers whose value is null are left out."""
    heads = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit("2024-01-01T00:00:00Z")), ("WARC-Target-URI", uri), *more, ("Content-Type", F.lit(media)), ("Content-Length", _octets(block))]
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(END)) for name, value in heads]
    return F.concat(F.lit(f"WARC/1.1{END}"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(END), block)


def elect(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Of (page_id, html): (digest, check, size, first_id, holders), for payloads of at least ``min_bytes`` that come more than once: the page that holds the payload, and how many rows are that page."""
    keyed = pages.select("page_id", F.sha1("html").alias("digest"), F.sha2("html", 256).alias("check"), F.octet_length("html").alias("size")).where(F.col("size") >= min_bytes)
    pages_held = keyed.groupBy("digest", "check", "size", "page_id").agg(F.count(F.lit(1)).alias("n"))
    held = pages_held.groupBy("digest", "check", "size").agg(F.max(F.struct("page_id", "n")).alias("x"), F.sum("n").alias("n"))
    return held.where("n > 1").select("digest", "check", "size", F.col("x.page_id").alias("first_id"), F.col("x.n").alias("holders"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT) -> None:
    """Write a request, a response or revisit, and a metadata record for each row of ``pages`` (page_id, url, html).

    A null payload is empty, a null url is ``about:blank``; line ends in a url are percent-encoded. Of
    equal payloads of at least ``min_bytes`` the largest page_id's is the response and the others
    refer to it; rows that repeat that id too are responses. A record that others refer to is named by its page and its payload's
    digest, all others by a random id. Where several rows are the page that holds a payload, no one of them is
    named: a revisit's metadata has the page in any case.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col("page_id").cast("string").alias("id"), F.col("page_id").alias("page_id"), clean.alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1("html").alias("digest"), F.sha2("html", 256).alias("check"), F.octet_length("html").alias("size"))
    first = stage(elect(rows.select("page_id", "html"), min_bytes), "elected")  # stored: a hot payload's rows can then be split in the join
    rows = rows.join(first, ["digest", "check", "size"], "left").withColumn("again", F.coalesce(F.col("first_id") != F.col("page_id"), F.col("first_id").isNotNull()))
    single = F.col("holders") == 1
    holder = F.when(single, F.concat(F.lit("<urn:capture:"), F.col("first_id").cast("string"), F.lit(":"), F.col("digest"), F.lit(":response>")))
    rows = rows.withColumn("part", F.when(single & (F.col("first_id") == F.col("page_id")), F.col("digest")).otherwise(F.expr("uuid()")))
    rows = rows.withColumn("own", F.concat(F.lit("<urn:capture:"), F.coalesce("id", F.lit("null")), F.lit(":"), F.col("part")))
    response, digest = F.concat("own", F.lit(":response>")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"
    status = F.concat(F.lit(f"{http}Content-Length: "), F.col("size").cast("string"), F.lit(END * 2))
    # A url may hold characters that break a request line; the request names the capture instead.
    request = F.concat(F.lit("GET / HTTP/1.1" + END + "X-Capture: "), F.coalesce("id", F.lit("")), F.lit(END * 2))
    fields = F.concat(F.lit("page: "), F.coalesce("id", F.lit("")), F.lit(f"{END}payload-bytes: "), F.col("size").cast("string"), F.lit(END), F.when(F.col("again"), F.concat(F.lit("refers-to-page: "), F.col("first_id").cast("string"), F.lit(END))).otherwise(""))
    to = ("WARC-Concurrent-To", response)
    main = F.when(
        F.col("again"),
        _record("revisit", response, F.col("url"), HTTP_RESPONSE, status, digest, ("WARC-Refers-To", holder), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
    ).otherwise(_record("response", response, F.col("url"), HTTP_RESPONSE, F.concat(status, "html"), digest))
    records = F.array(
        _record("request", F.concat("own", F.lit(":request>")), F.col("url"), HTTP_REQUEST, request, to), main, _record("metadata", F.concat("own", F.lit(":metadata>")), F.col("url"), FIELDS, fields, to)
    )
    out = rows.select(F.explode(records).alias("value"))
    out.write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * CAPTURES_A_FILE).text(path)


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive, by Content-Length; a broken archive raises ValueError."""
    at, view = 0, memoryview(data)
    while at < len(data):
        top = data.find(b"\r\n\r\n", at)
        if top < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        heads = dict(x.split(": ", 1) for x in data[at:top].decode("utf-8").split("\r\n")[1:])
        start, size = top + 4, int(heads["Content-Length"])
        if start + size + 4 > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        block = bytes(view[start : start + size])
        at = start + size + 4
        kind, status, payload, fields = heads["WARC-Type"], None, None, None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            status = http.split(b"\r\n", 1)[0].decode()
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode("utf-8").split("\r\n") if x)
        yield {
            "type": kind, "record_id": heads["WARC-Record-ID"], "concurrent_to": heads.get("WARC-Concurrent-To"), "refers_to": heads.get("WARC-Refers-To"), "uri": heads.get("WARC-Target-URI"),
            "payload_digest": heads.get("WARC-Payload-Digest"), "http_status": status, "payload": payload if kind == "response" else None, "fields": fields,
        }


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: see RECORDS."""
    import gzip

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                some: list[dict] = []
                for r in parse(gzip.decompress(data) if name.endswith(".gz") else data):
                    some.append(r)
                    if len(some) == 500:
                        yield pd.DataFrame(some)
                        some = []
                if some:
                    yield pd.DataFrame(some)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")
    return files.mapInPandas(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: response_id, request, response, metadata.

    Records are joined by the id of the response, which request and metadata name as concurrent.
    A request or metadata record without a response gives no capture; a response without them has
    nulls there. Of several concurrent records of one type the one with the smallest id counts.
    """
    def side(kind: str, *fields: str) -> DataFrame:
        body = F.struct("record_id", *fields)
        return records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("response_id")).agg(F.min_by(body, "record_id").alias(kind))

    main = records.where(F.col("type").isin("response", "revisit"))
    main = main.select(F.col("record_id").alias("response_id"), F.struct("type", "uri", "refers_to", "payload_digest", "http_status", "payload").alias("response"))
    return main.join(side("request", "uri"), "response_id", "left").join(side("metadata", "fields"), "response_id", "left").select("response_id", "request", "response", "metadata")


def captures(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back and assemble the captures."""
    path = f"{shared_dir(pages.sparkSession)}/sonolith-llm/warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes)
    return assemble(read(pages.sparkSession, path))


def page_index(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """For each row of ``pages``, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, request_uri.

    A response's size and digest are those of the payload read back; a revisit has them from its
    headers and metadata. request_uri is what the request record of the capture asks for. An empty table gives an empty result.
    """
    got = captures(pages, min_bytes)
    kind, payload = F.col("response.type"), F.col("response.payload")
    page = F.col("metadata.fields")["page"]
    return got.select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        F.when(kind == "response", F.octet_length(payload)).otherwise(F.col("metadata.fields")["payload-bytes"].cast("int")).cast("long").alias("payload_bytes"),
        F.when(kind == "response", F.sha1(payload)).otherwise(F.substring_index("response.payload_digest", ":", -1)).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(kind == "revisit", F.col("metadata.fields")["refers-to-page"].cast("long")).alias("refers_to"),
        F.col("request.uri").alias("request_uri"),
    )


ORACLE = """
WITH p AS (SELECT page_id, replace(replace(coalesce(url, 'about:blank'), chr(13), '%0D'), chr(10), '%0A') AS request_uri, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, request_uri, html, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND first_id <> page_id THEN first_id END AS refers_to, request_uri
FROM q
"""
