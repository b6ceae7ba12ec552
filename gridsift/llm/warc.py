"""WARC archives: written from a table of pages, read back, and put together to captures.

Every page gives a request, a response (or a revisit of an equal payload) and a metadata record; request and metadata name the response
in WARC-Concurrent-To. As payloads are text, Spark's text writer can write archives anywhere Spark can: a row holds a
page's three records, and the row separator is the blank line that ends a record. Reading parses whole files by the records'
lengths, so nothing in a payload can be taken for a record. Records meet again by their transaction, in one shuffle without payloads.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_path, stored
from .components import connected_components

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: About so many bytes of payload go into one file, which a task reads whole.
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def _record_id(kind: str, page: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}|"), F.coalesce(page.cast("string"), F.lit("")), F.lit("|"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " ")) for name, value in headers]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes gzip-compressed WARC files below path. Null html: an empty payload; null url: no target header; null id: no page header.

    Of equal payloads of at least REVISIT_BYTES, the page with the smallest id has the response and the others revisit it.
    Each repeated row gets its records too, with the same record ids.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    page, url = F.col(id_col), F.col(url_col)
    rows = pages.select(page.alias("page"), url.alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    facts = stored(rows.select("page", "digest", "size"), "page-digests")
    total = facts.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    firsts = facts.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    revisits = stored(facts.join(firsts, "digest").filter(~F.col("page").eqNullSafe(F.col("first"))).select(F.col("page").alias("r_page"), F.col("digest").alias("r_digest"), "first").distinct(), "revisits")
    few = revisits.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(revisits) if few else revisits, F.col("page").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    main, refers = _record_id("response", F.col("page"), F.col("digest")), _record_id("response", F.col("first"), F.col("digest"))
    again = F.col("first").isNotNull()
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url")), ("X-Page-Id", F.col("page"))]
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit(""))
    target = F.coalesce(F.regexp_extract("url", "^[a-z]+://[^/?#]*(/[^#]*)", 1), F.lit(""))
    get = F.regexp_replace(F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\nHost: "), host, F.lit("\n\n")), "\n", "\r\n")
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id("request", F.col("page"), F.col("digest"))), ("WARC-Concurrent-To", main), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], get)
    response = _record(
        [
            ("WARC-Type", F.when(again, "revisit").otherwise("response")),
            ("WARC-Record-ID", main),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(again, refers)),
            ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(status, F.when(again, "").otherwise(F.col("html"))),
    )
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id("metadata", F.col("page"), F.col("digest"))), ("WARC-Concurrent-To", main), *common, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payloadBytes: "), F.col("size").cast("string")))
    per_file = max(1, int(FILE_BYTES * total.n / max(total.size or 1, 1)))
    rows.select(F.concat(request, F.lit(END), response, F.lit(END), metadata).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


RECORDS = "kind string, record_id string, concurrent_to array<string>, refers_to string, url string, page_id long, bytes long, digest string, payload binary, fields string"
KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def unzipped(data: bytes) -> bytes:
    """A file's bytes: as they are, or those of all its gzip members, one after the other; zeros between members are padding."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def parsed(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (names in lower case, every value of each) and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers: dict[str, list[str]] = {}
        for name, _, value in (x.partition(":") for x in lines):
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        begin = end + 4
        stop = begin + int(headers["content-length"][0])
        if stop > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        yield headers, data[begin:stop]
        at = stop + 4


def read_archives(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """One row per record (RECORDS). Files are plain or gzip, of any number of members. concurrent_to: every identifier that the record names, null if none.
    Responses: bytes, digest (SHA-256) and, if asked for, payload, all from the payload itself. A record that is cut short is an error; no file, no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in RECORDS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, KINDS[kind]) for column, (_, kind) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parsed(unzipped(content.as_py())):
                    one = lambda name: headers.get(name, [None])[0]  # noqa: E731, B023
                    kind, length, digest, payload, text = one("warc-type"), None, (one("warc-payload-digest") or "").removeprefix("sha256:") or None, None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    elif kind == "metadata":
                        text = block.decode("utf-8", "replace")
                    page = one("x-page-id")
                    rows.append((kind, one("warc-record-id"), headers.get("warc-concurrent-to"), one("warc-refers-to"), one("warc-target-uri"), int(page) if page else None, length, digest, payload if payloads else None, text))
                    size += len(payload or b"") if payloads else 1000
                    if size > FILE_BYTES >> 2:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def _transactions(records: DataFrame) -> DataFrame:
    """records with transaction: the smallest record identifier that concurrent-to identifiers reach, through any number of records, there and back.

    Most records name the one response of their transaction, which names none: those are told by one look. What is left, as chains and records
    that name several, is put together by connected components over hashes of the identifiers.
    """
    main = F.col("kind").isin("response", "revisit") & F.col("concurrent_to").isNull()
    mains = records.filter(main).select(F.col("record_id").alias("main_id")).distinct()
    named = records.filter(F.col("concurrent_to").isNotNull()).select("record_id", F.explode("concurrent_to").alias("to"), F.size("concurrent_to").alias("k")).filter("`to` <> record_id OR record_id IS NULL")
    strays = stored(named.join(mains, F.col("to") == F.col("main_id"), "left").filter("main_id IS NULL OR k > 1").select("record_id", "to", "main_id"), "strays")
    first = F.when(F.col("concurrent_to").isNull() | ~F.array_contains(F.col("concurrent_to"), F.col("record_id")), F.element_at("concurrent_to", 1)).otherwise(None)
    records = records.withColumn("transaction", F.coalesce(first, F.col("record_id")))
    if strays.isEmpty():
        return records
    # A stray's neighbours: who names it, and whom those that it names are named by. Every link is taken, so chains of any length close.
    links = named.select(F.xxhash64("record_id").alias("u"), F.xxhash64("to").alias("v"))
    labels = connected_components(links)
    names = records.select(F.col("record_id").alias("x")).union(named.select("to")).filter("x IS NOT NULL").distinct()
    of = names.join(labels, F.xxhash64("x") == F.col("node")).groupBy("component").agg(F.min("x").alias("least"))
    known = labels.join(of, "component").select("node", "least")
    out = records.join(known, F.xxhash64("record_id") == F.col("node"), "left")
    return out.withColumn("transaction", F.coalesce("least", "transaction")).drop("node", "least")


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: transaction, main (response or revisit), request, metadata, and what a revisit refers to (bytes, digest and page of the response).

    Requests and metadata join their response through WARC-Concurrent-To, whichever of the two names the other, directly or through other records, or
    several of them; where either is missing it is null, and of several the one with the smallest identifier is taken. A transaction of more than
    one response gives a row for each, with the same request and metadata. A response that was written more than once gives a row for each
    time; records whose response is missing give none. An empty table gives an empty result; other columns are not read.
    """
    record = F.struct("record_id", "kind", "refers_to", "url", "page_id", "bytes", "digest", "payload", "fields")
    is_main = F.col("kind").isin("response", "revisit")
    rows = _transactions(records.filter(is_main | F.col("kind").isin("request", "metadata"))).select("transaction", is_main.alias("is_main"), F.col("kind").alias("of_kind"), record.alias("record"))
    of = lambda kind: F.min_by(F.when(F.col("of_kind") == kind, F.col("record")), F.when(F.col("of_kind") == kind, F.struct("record.record_id", "record.fields"))).alias(kind)
    more = rows.filter("NOT is_main").groupBy("transaction").agg(of("request"), of("metadata"))
    # Captures by the page's or transaction's name: written, as they are needed twice.
    whole = stored(rows.filter("is_main").select("transaction", F.col("record").alias("main")).join(more, "transaction", "left"), "captures")
    wanted = whole.filter("main.kind = 'revisit'").select(F.col("main.refers_to").alias("target")).distinct()
    referred = F.struct(F.col("main.bytes").alias("bytes"), F.col("main.digest").alias("digest"), F.col("main.page_id").alias("page_id"))
    seen = whole.filter("main.kind = 'response'").select(F.col("main.record_id").alias("target"), referred.alias("referred")).join(wanted, "target", "left_semi")
    # One for each identifier, however often it was written.
    seen = seen.groupBy("target").agg(F.min("referred").alias("referred"))
    few = seen.count() <= BROADCAST_ROWS
    return whole.join(F.broadcast(seen) if few else seen, F.col("main.refers_to") == F.col("target"), "left").drop("target")


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages to archives in the shared folder (release() deletes them) and returns their captures() read back. Nulls, repeated rows and empty tables as in write_archives()."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, id_col=id_col, url_col=url_col, html_col=html_col)
    return captures(read_archives(spark, path))
