"""WARC archives of captures and the assembly of their transactions.

A capture is written as three records: the response (or, for a payload that an
earlier capture holds, a revisit of it), the request and a metadata record. The
last two name the first in ``WARC-Concurrent-To``. Reading joins the three
through that identifier and gives one nested row per capture.

Archives are gzip members, one per record, as rows (archive, data) of a table
that Spark writes, so that they can lie in any store Spark reaches; ``data`` of
a row is a complete .warc.gz file of at most about ``SEGMENT`` bytes.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome_spark.llm.common import join_counted, materialize

SEGMENT, LEVEL, LEAST = 4 << 20, 1, 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "archive string, type string, record_id string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes bigint, payload_digest string, fields map<string,string>"


def record_id(kind: str, page_id, digest: str) -> str:
    h = hashlib.md5(f"{kind}/{page_id}/{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def render(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; line breaks in values become spaces."""
    lines = ["WARC/1.1", *[f"{k}: {' '.join(str(v).splitlines())}" for k, v in headers], f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def transaction(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> list[bytes]:
    """The three records of a capture. ``refers_to``: the page that holds the payload, or None."""
    uri = url or ""
    kind = "response" if refers_to is None else "revisit"
    own = record_id("capture", page_id, digest)
    head = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    main = [("WARC-Type", kind), ("WARC-Record-ID", own), *head, ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        main += [("WARC-Refers-To", record_id("capture", refers_to, digest)), ("WARC-Profile", PROFILE)]
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    get = f"GET {uri.split('://', 1)[-1].partition('/')[2]} HTTP/1.1\r\nHost: {uri.split('://', 1)[-1].partition('/')[0]}\r\n\r\n".encode()
    return [
        render(main, http + (payload if refers_to is None else b"")),
        render([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page_id, digest)), ("WARC-Concurrent-To", own), *head, ("Content-Type", "application/http;msgtype=request")], get),
        render([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_id, digest)), ("WARC-Concurrent-To", own), *head, ("Content-Type", "application/warc-fields")], fields),
    ]


def parse(data: bytes):
    """(headers, block) of every record of an archive, one gzip member at a time.

    No bytes, no records; what is cut short or is not WARC raises ValueError.
    """
    view, at = memoryview(data), 0
    while at < len(data):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            step = view[at : at + 65536]
            if not len(step):
                raise ValueError("the archive ends inside a record")
            out.append(unpack.decompress(step))
            at += len(step) - len(unpack.unused_data)
        raw, pos = b"".join(out), 0
        while pos < len(raw):
            end = raw.index(b"\r\n\r\n", pos)
            version, *lines = raw[pos:end].decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(headers["content-length"])
            yield headers, raw[end + 4 : end + 4 + size]
            pos = end + 4 + size + 4


def _sound(data: bytes):
    """The records of ``parse`` and, in place of its error, one of type ``damaged``."""
    try:
        for headers, block in parse(data):
            yield {"warc-type": "", **headers}, block
    except (ValueError, KeyError, zlib.error):
        yield {"warc-type": "damaged"}, b""


def first_captures(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, first, _n, _size): of payloads of at least ``least`` bytes that several
    pages hold, the smallest page_id, the pages and their bytes in all."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("bigint").alias("n")).filter(F.col("n") >= least)
    many = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_size"))
    return many.filter("_n > 1")


def write_archives(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all captures and return the table (archive, data) as read back.

    A payload that very many pages hold doesn't meet in one task: such digests,
    a bounded number, go to the pages instead.
    """
    first = materialize(first_captures(pages, least), "warc-first")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    total = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(body).cast("bigint"))).first()
    rows = pages.select("page_id", "url", body.alias("body")).withColumn("digest", F.sha2("body", 256))
    rows = join_counted(rows, first, ["digest"], total[0], "left", total[1] or 0).select("page_id", "url", "body", "digest", "first")

    def pack(batches):
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page, url, payload, digest, first in zip(*[c for c in batch.columns], strict=True):
                page, first, digest = page.as_py(), first.as_py(), digest.as_py()
                made = transaction(page, url.as_py(), payload.as_py(), digest, None if first is None or first == page else first)
                held += made
                size += sum(map(len, made))
                if size >= SEGMENT:
                    yield pa.record_batch([pa.array([f"part-{part:05d}-{number:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "data"])
                    number, held, size = number + 1, [], 0
        if held:
            yield pa.record_batch([pa.array([f"part-{part:05d}-{number:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "data"])

    return materialize(rows.mapInArrow(pack, "archive string, data binary"), "warc")


def read_records(archives: DataFrame) -> DataFrame:
    """One row per record of (archive, data) rows; payloads are hashed, not kept.

    Null or empty data give no rows. Of an archive that is damaged the records
    before the damage come back, then one row of type ``damaged``. Repeated
    archives give their records again.
    """

    def unpack(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                out = []
                for h, block in _sound(data.as_py() or b""):
                    fields, size, digest = None, None, None
                    if h["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    elif h["warc-type"] == "metadata":
                        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)]
                    out.append((name.as_py(), h["warc-type"], h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), size, digest, fields))
                kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
                names = ["archive", "type", "record_id", "concurrent_to", "refers_to", "uri", "digest", "payload_bytes", "payload_digest", "fields"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names)

    return archives.mapInArrow(unpack, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture``, its ``request``, ``metadata`` and, for
    a revisit, ``original``: the response that it refers to.

    A capture without a request or metadata record has null there; of several
    for one capture the first by record id counts; requests and metadata that
    name no capture are left out.
    """
    records = materialize(records, "warc-records")
    body = F.struct("record_id", "uri", "digest", "payload_bytes", "payload_digest", "fields", "archive")
    main = records.filter(F.col("type").isin("response", "revisit")).select("record_id", "type", "refers_to", body.alias("capture"))

    def side(kind: str) -> DataFrame:
        return records.filter(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(body, "record_id").alias(kind))

    joined = main.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")
    nothing = F.lit(None).cast("struct<payload_bytes:bigint,payload_digest:string,page_id:string>")
    kept = ["type", "refers_to", "capture", "request", "metadata", "original"]
    # responses refer to nothing and stay where they are; of those referred to there is one row each
    wanted = records.filter((F.col("type") == "revisit") & F.col("refers_to").isNotNull()).groupBy(F.col("refers_to").alias("record_id")).agg(F.count(F.lit(1)).alias("_n"))
    original = joined.filter(F.col("type") == "response").drop("refers_to").join(wanted, "record_id")
    held = F.struct("capture.payload_bytes", "capture.payload_digest", F.element_at("metadata.fields", "page-id").alias("page_id"))
    original = materialize(original.groupBy(F.col("record_id").alias("refers_to")).agg(F.min(held).alias("original"), F.max("_n").alias("_n")), "warc-originals")
    responses = joined.filter(F.col("type") == "response").withColumn("original", nothing).select(*kept)
    revisits = joined.filter(F.col("type") == "revisit")
    return responses.unionByName(join_counted(revisits, original, ["refers_to"], records.count(), "left").select(*kept))


def captures(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` to archives, read them back and return per page: page_id,
    payload_bytes, payload_digest, record_type and refers_to.

    A null html is an empty payload. Payloads shorter than ``least`` bytes are
    always responses. Rows that repeat a page_id and payload are captures of
    their own, alike in every column; a null page_id stays null and holds a
    payload for others only where no other page does. No pages, no rows.
    """
    whole = assemble(read_records(write_archives(pages, least)))
    kind = pages.schema["page_id"].dataType
    revisit = F.col("type") == "revisit"
    return whole.select(
        F.element_at("metadata.fields", "page-id").cast(kind).alias("page_id"),
        F.when(revisit, F.col("original.payload_bytes")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("original.payload_digest")).otherwise(F.col("capture.payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("original.page_id").cast(kind).alias("refers_to"),
    )
