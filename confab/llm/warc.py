"""WARC archives: writing captures, and assembling transactions from what is read back.

A page becomes three records: a request, a response (or a revisit, where another page has
the same payload) and a metadata record. Request and metadata name the response in
``WARC-Concurrent-To``; a revisit names, in ``WARC-Refers-To``, the response it repeats.
Files are gzip, one member a record, and are cut after ``file_bytes``. As with all files
here, only those that the committed manifest lists are read.

Reading parses the records in parallel and joins requests and metadata to responses by
their concurrent-to identifiers; each capture is one nested row.

Which payloads repeat is found from digests alone: pages are grouped by digest, and only
digests that occur more than once are joined back, by broadcast if at most
``max_broadcast`` of them exist, else by shuffle.

Edge cases: a null page is an empty payload; payloads under ``min_revisit`` bytes never
are revisits. Of equal payloads the smallest page_id is the response, null ids last; all
rows that tie for it, repeated rows, are responses. Rows equal in id and payload have equal
records: they are assembled once and returned as often as they were written. Empty tables
give no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl_schema, materialize, new_path, slices, spread_join, table

DATE = "2024-01-01T00:00:00Z"


def record_id(*parts) -> str:
    """A UUID that follows from the parts, so a repeated task writes the same records."""
    return f"urn:uuid:{uuid.UUID(hashlib.sha256(repr(parts).encode()).hexdigest()[:32])}"


def record(kind: str, rid: str, body: bytes, content_type: str, **headers) -> bytes:
    """One record. Header names are given with _ for -; None leaves a header out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + body + b"\r\n\r\n"


def clean_uri(url: str | None) -> str:
    """A header value cannot hold line breaks."""
    return "urn:none" if not url else "".join(c for c in url if c not in "\r\n")


def page_records(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> list[bytes]:
    """Request, response or revisit, and metadata of a page. ``refers_to``: (page_id,) of its response, or None."""
    uri, rid = clean_uri(url), record_id("response", page_id, digest)
    host = uri.split("//")[-1].split("/")[0]
    request = f"GET {uri} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha256:{digest}"}
    if refers_to is None:
        main = record("response", rid, status + payload, "application/http; msgtype=response", **common)
    else:
        main = record("revisit", rid, status, "application/http; msgtype=response", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<{record_id('response', refers_to[0], digest)}>", **common)
    fields = f"page-id: {'' if page_id is None else page_id}\r\nhas-url: {int(url is not None)}\r\n".encode()
    return [
        record("request", record_id("request", page_id, digest), request, "application/http; msgtype=request", WARC_Target_URI=uri, WARC_Concurrent_To=f"<{rid}>"),
        main,
        record("metadata", record_id("metadata", page_id, digest), fields, "application/warc-fields", WARC_Target_URI=uri, WARC_Concurrent_To=f"<{rid}>"),
    ]


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, path: str, min_revisit: int = 100, file_bytes: int = 32_000_000, max_broadcast: int = 100_000) -> DataFrame:
    """Write pages (page_id, url, html) under ``path``; returns the committed manifest: file, n_records."""
    ddl = "file string,n_records long"
    schema = ddl_schema(ddl)
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest = F.sha2(body.cast("binary"), 256)
    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), digest.alias("digest"))
    sizes = some.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    twice = materialize(sizes.where("n > 1").select("digest", "first", "n"), "warc-twice")
    few = twice.count() <= max_broadcast
    joined = some.join(F.broadcast(twice), "digest", "left") if few else spread_join(some, twice, ["digest"], "n", "page_id")
    marked = joined.select("page_id", "url", "html", "digest", "first")

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        out, file, count, size = None, "", 0, 0
        for part in slices(batches):
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None:
                    file, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{file}", compression=None)
                revisit = first is not None and page_id != first
                for data in page_records(page_id, url, html.encode("utf-8"), digest, (first,) if revisit else None):
                    data = member(data)
                    out.write(data)
                    count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield table(schema, [[file], [count]])
        if out is not None:
            out.close()
            yield table(schema, [[file], [count]])

    return materialize(marked.mapInArrow(write, ddl), "warc-manifest")


def read_members(stream, size: int = 1 << 20):
    """The records of a gzip stream, one member each, with no more than one in memory."""
    pending = b""
    unpack, parts = zlib.decompressobj(31), []
    while True:
        data = pending or stream.read(size)
        if not data:
            return
        parts.append(unpack.decompress(data))
        pending = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, body)"""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


RECORDS = "kind string,id string,concurrent_to string,refers_to string,uri string,digest string,bytes long,page_id string,body binary"


def read_records(spark: SparkSession, path: str, manifest: DataFrame, with_body: bool = False) -> DataFrame:
    """Every record of the archives. ``digest`` and ``bytes`` are measured on a response's payload;
    a revisit has its header's digest and null bytes."""
    schema = ddl_schema(RECORDS)

    def bare(value):
        return value.strip("<>") if value else None

    def read(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{file}", compression=None) as f:
                    for raw in read_members(f):
                        h, body = parse_record(raw)
                        kind, page, digest, n = h["warc-type"], None, None, None
                        if kind == "response":
                            body = body.partition(b"\r\n\r\n")[2]
                            digest, n = hashlib.sha256(body).hexdigest(), len(body)
                        elif kind == "revisit":
                            digest = h["warc-payload-digest"].rpartition(":")[2].lower()
                        elif kind == "metadata":
                            page = dict(x.split(": ", 1) for x in body.decode().split("\r\n") if ": " in x).get("page-id")
                        rows.append((kind, bare(h["warc-record-id"]), bare(h.get("warc-concurrent-to")), bare(h.get("warc-refers-to")), h.get("warc-target-uri"), digest, n, page, body if with_body else None))
                        if len(rows) >= (64 if with_body else 2048):
                            yield table(schema, zip(*rows, strict=True))
                            rows = []
                if rows:
                    yield table(schema, zip(*rows, strict=True))

    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("file").repartition(n).mapInArrow(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: id, page_id, request, response, metadata (structs)."""
    # one grouping, so the archives are read once; a record's capture is what it is concurrent to, or itself
    is_main = F.col("kind").isin("response", "revisit")
    own = lambda kind, *cells: F.first(F.when(F.col("kind") == kind, F.struct(*cells)), ignorenulls=True)
    main = F.first(F.when(is_main, F.struct("kind", "uri", "digest", "bytes", "refers_to", "body")), ignorenulls=True)
    request = own("request", F.col("id").alias("request_id"), "uri", "body")
    metadata = own("metadata", F.col("id").alias("metadata_id"), "page_id", "body")
    joined = records.groupBy(F.coalesce("concurrent_to", "id").alias("capture")).agg(main.alias("response"), request.alias("request"), metadata.alias("metadata"), F.count_if(is_main).alias("copies"))
    joined = joined.where("copies > 0").withColumnRenamed("capture", "id")
    page = F.nullif(F.col("metadata.page_id"), F.lit("")).cast("long")
    every = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return every.select("id", page.alias("page_id"), "request", "response", "metadata")


def capture_digest(pages: DataFrame, **settings) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and return per page
    page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id)."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    manifest = write_archives(pages, path, **settings)
    captures = materialize(assemble(read_records(spark, path, manifest)).select("id", "page_id", F.col("response.kind").alias("kind"), F.col("response.digest").alias("digest"), F.col("response.bytes").alias("bytes"), F.col("response.refers_to").alias("refers_to")), "warc-captures")
    old = captures.where("kind = 'revisit'")
    # only responses that are referred to; one of very many revisits is dealt to several parts
    asked = old.groupBy("refers_to").agg(F.count("*").alias("n"))
    firsts = captures.where("kind = 'response'").groupBy(F.col("id").alias("refers_to")).agg(F.first("page_id").alias("first_page"), F.first("bytes").alias("first_bytes")).join(asked, "refers_to")
    revisits = spread_join(old, firsts, ["refers_to"], "n", "id")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    old = revisits.select("page_id", F.col("first_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("first_page").alias("refers_to"))
    new = captures.where("kind = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return new.select(*columns).unionByName(old.select(*columns))
