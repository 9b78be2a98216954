"""WARC archives without repeated payloads.

Headers (page, digest, length) are shuffled by payload digest. In each group of equal payloads the
smallest page becomes the response and the others become revisits of it, with fresh headers that
refer to its record. Payloads meet their headers again by digest and are written by Spark's text
writer, one record per row: the record separator of the format, two line ends, is the writer's line
separator. Archives are gzip files of ``spark.sql.files`` size; no task holds more than its record.

Reading splits the archives at the version line and joins the pieces again by the stated block
length, so that payloads may hold anything, also a version line. Lengths and digests of responses are
computed from the payloads read; revisits get theirs from the response they refer to, by a join.

Defined results: null html is an empty payload; null urls are written as ``urn:none:`` and line ends
in a url are percent-encoded; a page that occurs twice is written twice; pages without an id are
revisits if any page with an id has their payload, else responses; equal payloads shorter than
``min_bytes`` are all responses; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.llm.common import scratch_path

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
RECORD = "urn:page:"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 digest, from its hex digits, 5 (20 bits) at a time."""
    digits = F.sha1(data)

    def four(i: int) -> list[Column]:
        bits = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*[c for i in range(8) for c in four(i)])


def _text(value: Column) -> Column:
    """A header value on one line."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and the decision: digest, original (null for responses)."""
    payload = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    headers = pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("bytes"))
    # Only groups with something to revisit are joined: pre-aggregated, one row per repeated digest.
    repeated = headers.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    )
    repeated = repeated.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    joined = hashed.join(repeated, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("original"))


def records(resolved: DataFrame, date: str = DATE) -> DataFrame:
    """One WARC record per row, as text without the closing separator."""
    revisit = F.col("original").isNotNull()
    url = F.coalesce(_text(F.col("url")), F.lit("urn:none:"))
    length = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit(END))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(length)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    head = F.concat(
        F.lit(VERSION + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.concat(F.lit(f"\r\nWARC-Record-ID: <{RECORD}"), page, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url),
        F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), sha1_base32(F.col("payload").cast("binary"))),
        F.when(
            revisit,
            F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{RECORD}"), F.col("original"), F.lit(">")),
        ).otherwise(""),
        F.concat(F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), block, F.lit(END)),
    )
    return resolved.select(F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """Write the pages as gzip archives without repeated payloads."""
    out = records(resolve(pages, min_bytes)).write.mode("overwrite")
    out.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    return path


def _field(head: bytes, name: bytes) -> str | None:
    at = head.find(b"\r\n" + name + b": ")
    if at < 0:
        return None
    start = at + len(name) + 4
    return head[start : head.find(b"\r\n", start)].decode()


def _page(uri: str | None) -> int | None:
    page = uri[len(RECORD) + 1 : -1] if uri else "none"
    return None if page == "none" else int(page)


def _parsed(with_payload: bool):
    """Parser of one partition: pieces between version lines, in file order, to records."""
    names = ["page_id", "url", "record_type", "digest", "refers_to", "bytes", *["payload"] * with_payload]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def parse(batches):
        whole, missing = [], 0
        for batch in batches:
            out: list[tuple] = []
            for piece in batch.column(0):
                piece = piece.as_py()
                if missing > 0:  # the version line was part of the payload
                    whole.append(VERSION.encode() + piece)
                    missing -= len(whole[-1])
                elif piece:
                    head = piece.find(END.encode())
                    missing = int(_field(b"\r\n" + piece[: head + 2], b"Content-Length")) + head + 4 + len(END) - len(piece)
                    whole = [piece]
                else:
                    continue
                if missing <= 0:
                    out.append(_record(b"".join(whole), with_payload))
                    whole = []
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types[: len(names)], strict=True)], names=names)

    return parse


def _record(raw: bytes, with_payload: bool) -> tuple:
    end = raw.find(END.encode())
    head = b"\r\n" + raw[: end + 2]
    block = raw[end + 4 : end + 4 + int(_field(head, b"Content-Length"))]
    payload = block[block.find(END.encode()) + 4 :]
    kind, digest = _field(head, b"WARC-Type"), _field(head, b"WARC-Payload-Digest").removeprefix("sha1:")
    size = None
    if kind == "response":
        size = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload digest of {_field(head, b'WARC-Record-ID')} does not hold")
    fields = (_page(_field(head, b"WARC-Record-ID")), _field(head, b"WARC-Target-URI"), kind, digest, _page(_field(head, b"WARC-Refers-To")), size)
    return (*fields, payload.decode()) if with_payload else fields


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the archives, payload lengths and digests checked; revisits without a length."""
    pieces = spark.read.option("lineSep", VERSION).text(path).select(F.col("value").cast("binary").alias("value"))
    schema = "page_id long, url string, record_type string, digest string, refers_to long, bytes long"
    return pieces.mapInArrow(_parsed(with_payload), schema + (", payload string" if with_payload else ""))


def with_originals(found: DataFrame) -> DataFrame:
    """Records with the length of their full payload: revisits are joined to their responses."""
    original = F.col("record_type") == "response"
    # A page written twice is two equal responses; one of them is enough.
    firsts = found.filter(original).groupBy("page_id", "digest").agg(F.max("bytes").alias("full"))
    firsts = firsts.select(F.col("page_id").alias("refers_to"), "digest", "full")
    joined = found.filter(~original).join(firsts, ["refers_to", "digest"], "left")
    columns = ["page_id", "url", "record_type", "digest", "refers_to"]
    return found.filter(original).select(*columns, "bytes").unionByName(joined.select(*columns, F.col("full").alias("bytes")))


def op3(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back and report each record."""
    spark = pages.sparkSession
    found = with_originals(read_archives(spark, write_archives(pages, scratch_path(spark, "warc"))))
    return found.select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )
