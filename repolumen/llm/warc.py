"""WARC archives: writing captures, reading records back, and transaction assembly.

A capture is three records, all written next to each other: the response (or a revisit, if its payload equals that of
another capture), and a request and a metadata record that name it in ``WARC-Concurrent-To``. Record ids are URNs
made from the capture, so no lookup is needed to refer to one.

Archives are written by Spark's text writer with the record end ``CRLF CRLF`` as line separator, so they work on any
file system that Spark writes to and are committed like any other output. They are read as binary files and cut by
``Content-Length`` alone; payloads may hold any text, line separators and WARC headers included. The number of files
follows the number of bytes, so that a file stays small enough for one task.

Assembly joins the records of a transaction through their concurrent-to identifiers into one nested row per capture.

Cases: null payloads are empty, null addresses become ``urn:pages:none``; line ends and blanks in addresses are
percent-encoded. Rows equal in id, address and payload are one capture. A null id is a capture without id: it can
revisit, and is the response only among captures without ids. Empty tables write no record. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

FILE_BYTES = 24 << 20
_END = "\r\n\r\n"
_B32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes: five bytes make eight digits."""
    digest = F.sha1(text.cast("binary"))
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0"), *_B32)
                      for k in range(4)])


def _lines(*pairs) -> Column:
    """Header lines; a pair with a null value is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
                      for name, value in pairs])


def _record(kind: Column, record_id: Column, headers: list, block: Column) -> Column:
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\n"), _lines(
        ("WARC-Record-ID", record_id), *headers, ("Content-Length", F.octet_length(block))), F.lit("\r\n"), block)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write every capture of ``pages(page_id, url, html)`` below ``path`` as gzip-compressed archives.

    Of captures with equal payloads of at least ``least_bytes``, the one with the largest id holds the payload; the
    others are revisits that refer to it. That decision runs on digests, not on payloads.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    address = F.coalesce(F.col("url").cast("string"), F.lit("urn:pages:none"))
    captures = pages.select(F.col("page_id").cast("long").alias("page_id"), address.alias("url"), body.alias("body")) \
        .withColumn("capture", F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
                                           F.lower(F.hex(F.xxhash64("url", "body")))))
    narrow = materialize(captures.select("capture", "page_id", base32_sha1(F.col("body")).alias("digest"),
                                         F.octet_length("body").cast("long").alias("bytes")).distinct(), "warc-digests")
    # The largest id of a payload, and with it the capture that holds the payload.
    rank = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), "capture")
    holders = narrow.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(
        F.max(rank).alias("h")).select("digest", "bytes", F.col("h.capture").alias("holder"))
    roles = narrow.join(holders, ["digest", "bytes"], "left") \
        .select("capture", "digest", "bytes", F.coalesce("holder", "capture").alias("holder"))
    total = narrow.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    files = max(1, ((total.b or 0) + 1200 * total.n) // FILE_BYTES)

    revisit = F.col("holder") != F.col("capture")
    urn = F.concat(F.lit("<urn:pages:response:"), F.col("capture"), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(_END))
    when = F.lit(date)
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    common = [("WARC-Target-URI", uri), ("WARC-Date", when)]
    concurrent = [*common, ("WARC-Concurrent-To", urn)]
    host = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[a-z]+://([^/?#]+)", 1), F.lit("")), F.lit("unknown"))
    target = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[a-z]+://[^/?#]+([^#]*)", 1), F.lit("")), F.lit("/"))

    def named(kind: str) -> Column:
        return F.concat(F.lit(f"<urn:pages:{kind}:"), F.col("capture"), F.lit(">"))
    records = F.array(
        _record(F.when(revisit, "revisit").otherwise("response"), urn, [
            *common, ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(revisit, F.lit(
                "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:pages:response:"), F.col("holder"), F.lit(">")))),
            ("Content-Type", F.lit("application/http; msgtype=response"))],
            F.when(revisit, http).otherwise(F.concat(http, F.col("body")))),
        _record(F.lit("request"), named("request"), [*concurrent,
                ("Content-Type", F.lit("application/http; msgtype=request"))],
                F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END))),
        _record(F.lit("metadata"), named("metadata"), [*concurrent, ("Content-Type", F.lit("application/warc-fields"))],
                F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit("\r\n"))))
    # Both sides are dealt to as many parts as there are to be files, so the payloads are moved once.
    captures.repartition(files, "capture").join(roles.repartition(files, "capture"), "capture") \
        .select(F.explode(records).alias("value")) \
        .write.option("lineSep", _END).option("compression", "gzip").text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (lower-case names) and block of each record of an uncompressed archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at: at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = {m.group(1).decode().strip().lower(): m.group(2).decode() for m in
                _FIELD.finditer(data, data.index(b"\r\n", at) + 2, end + 2)}
        size = int(head["content-length"])
        yield head, view[end + 4: end + 4 + size]
        at = end + 4 + size
        if data[at: at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {at}")
        at += 4


def _payload(kind: str, block: memoryview) -> tuple[int | None, bytes | None]:
    """Length that the HTTP head states, and the payload of a response."""
    raw = bytes(block)
    cut = raw.find(b"\r\n\r\n")
    if kind not in ("response", "revisit") or cut < 0:
        return None, None
    stated = next((int(m.group(2)) for m in _FIELD.finditer(raw, 0, cut + 2)
                   if m.group(1).strip().lower() == b"content-length"), None)
    return stated, raw[cut + 4:] if kind == "response" else None


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import gzip
    columns = ["record_id", "kind", "uri", "date", "concurrent_to", "refers_to", "digest", "stated_bytes", "payload",
               "block"]

    def text(view) -> str:
        return bytes(view).decode("utf-8", "replace")
    for frame in frames:
        for content in frame["content"]:
            data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
            rows, held = [], 0
            for head, block in parse_records(data):
                kind = head["warc-type"]
                stated, payload = _payload(kind, block)
                rows.append((head["warc-record-id"], kind, head.get("warc-target-uri"), head.get("warc-date"),
                             head.get("warc-concurrent-to"), head.get("warc-refers-to"),
                             (head.get("warc-payload-digest") or ":").split(":", 1)[1] or None, stated,
                             None if payload is None else payload.decode("utf-8", "replace"),
                             None if kind in ("response", "revisit") else text(block)))
                held += len(block)
                if held > 8 << 20 or len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return found.mapInPandas(_records, "record_id string, kind string, uri string, date string, concurrent_to string, "
                             "refers_to string, digest string, stated_bytes long, payload string, block string")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` holds the response or revisit, ``request`` and ``metadata`` what is
    concurrent to it; either may be missing. The full payload's length and digest stand beside the payload itself."""
    main = records.where(F.col("kind").isin("response", "revisit"))
    digest = F.when(F.col("kind") == "response", base32_sha1(F.col("payload"))).otherwise(F.col("digest"))
    size = F.when(F.col("kind") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("stated_bytes"))
    captures = main.select(F.col("record_id"), F.struct(
        "record_id", "kind", "uri", "date", "refers_to", digest.alias("digest"), size.alias("payload_bytes"),
        "payload").alias("capture"))
    for kind in ("request", "metadata"):
        side = records.where((F.col("kind") == kind) & F.col("concurrent_to").isNotNull()).groupBy(
            F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct("record_id", "uri", "date", "block")).alias(kind))
        captures = captures.join(side, "record_id", "left")
    return captures.drop("record_id")


def captured_id(urn: Column) -> Column:
    """Page id inside a response's record id; null for a capture without id."""
    return F.nullif(F.regexp_extract(urn, r"^<urn:pages:response:(-?\d+)-", 1), F.lit("")).cast("long")
