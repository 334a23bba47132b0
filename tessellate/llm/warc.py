r"""WARC archives: written one gzip member per record, and read back record by record.

Writing goes through Spark's text sink, so archives land in any store that Spark writes to, under its commit protocol.
That sink ends each row with a separator; here it is the zero byte that a gzip member ends with anyway (the
highest byte of its length modulo 2^32; a longer record is followed by an empty member, which ends so too). Part files so
are plain concatenations of members, as ``.warc.gz`` files are. ``archive_bytes`` bounds an archive's size; one record over
it has an archive of its own.

The reader goes through an archive once, from the store, chunk by chunk, where Python can open it; from other stores Spark hands it
whole archives, which the bound keeps small. It inflates chunk by chunk, ends a record where its gzip member ends, frames the
block by Content-Length, and compares both digests with what it read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import urllib.parse
import urllib.request
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellate.llm._common import checkpoint_dir, table

CHUNK = 1 << 16
ARCHIVE_BYTES = 32 << 20
STREAMED = ("file", "hdfs", "s3", "gs")
EMPTY = zlib.compress(b"", 1, 31)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit holds the HTTP header alone."""
    block = _http(payload) + (b"" if revisit else payload)
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Block-Digest": "sha1:" + sha1_base32(block),
        "WARC-Payload-Digest": "sha1:" + sha1_base32(payload),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    member = zlib.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n", 1, 31)
    return member if member[-1] == 0 else member + EMPTY


class BadRecord(ValueError):
    """A record that isn't whole, or isn't what its digests say."""


def members(archive) -> Iterator[bytearray]:
    """The inflated gzip members of an archive (bytes, or a file open for reading), one at a time, by steps of CHUNK bytes."""
    file = archive if hasattr(archive, "read") else io.BytesIO(archive)
    held = file.read(CHUNK)
    while held:
        inflate, out = zlib.decompressobj(31), bytearray()
        while not inflate.eof:
            if not held:
                raise BadRecord("the archive ends within a member")
            try:
                out += inflate.decompress(held)
            except zlib.error as e:
                raise BadRecord(str(e)) from e
            held = inflate.unused_data if inflate.eof else file.read(CHUNK)
        held = held or file.read(CHUNK)
        yield out


def opened(path: str):
    """A file of a store that Python can open."""
    if path.startswith("file:"):
        return open(urllib.request.url2pathname(urllib.parse.urlsplit(path).path), "rb")
    store, inner = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner)


def parse(member: bytearray) -> dict:
    """The record in one member: page, type, refers_to, digest, payload length and payload (None for a revisit)."""
    end = member.find(b"\r\n\r\n")
    lines = bytes(member[: max(end, 0)]).decode().split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/1."):
        raise BadRecord("no WARC header")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block = bytes(member[end + 4 : end + 4 + length])
    if len(block) != length or member[end + 4 + length :] != b"\r\n\r\n":
        raise BadRecord("the block isn't as long as Content-Length says")
    if fields["warc-block-digest"] != "sha1:" + sha1_base32(block):
        raise BadRecord("the block doesn't match its digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
    digest, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or digest != sha1_base32(payload)):
        raise BadRecord("the payload doesn't match its digest")
    number = lambda urn: int(n) if (n := urn.removeprefix("<urn:page:").rstrip(">")) else None
    return {
        "page_id": number(fields["warc-record-id"]),
        "record_type": fields["warc-type"],
        "refers_to": number(fields["warc-refers-to"]) if revisit else None,
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": None if revisit else payload,
        "url": fields["warc-target-uri"],
    }


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
    least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Writes a record for each row to archives in ``folder``.

    Of equal payloads of at least ``least_bytes``, the row of the smallest id is the response, others revisit it.

    - null text: an empty payload. Null url: an empty one. Null id: a record without a number, which never is
      revisited where its payload has an id; among null ids alone, all are responses.
    - very long texts: one record each, held whole by the task that writes it. Ties: equal payloads of one id are all responses.
    - repeated rows (same id): each gets a record; rows of the responding id are all responses.
    - empty table: no archives hold a record. Further columns are neither read nor written.
    """
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"))
    # Both digests and the length: one SHA-1 can be forged.
    key = F.unhex(F.concat(F.sha2("_payload", 256), F.sha1("_payload")))
    first = (
        rows.filter(F.octet_length("_payload") >= least_bytes)
        .groupBy(key.alias("_key"))
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(F.concat("_key", F.lit(b"")).alias("_of"), "_first")
    )
    dealt = rows.withColumn("_key", key).join(first, F.col("_key") == F.col("_of"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, body, at = (batch.column(c)[i].as_py() for c in range(4))
                made = record(page, url, body, at, at is not None and at != page)
                if held and size + len(made) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["archive"])
                    held, size = [], 0
                held.append(made)
                size += len(made)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["archive"])

    # A row is an archive, and the separator its last byte.
    out = dealt.select("_id", "_url", "_payload", "_first").mapInArrow(run, "archive binary")
    out.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).mode("overwrite").text(folder)


def read_warc(spark, folder: str, payloads: bool = False) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes[, payload]) of all records in ``folder``.

    A record that is cut short or doesn't match its digests fails the job.
    """
    found = spark.read.format("binaryFile").load(folder)
    first = found.select("path").first()
    streamed = bool(first) and first.path.split(":")[0] in STREAMED
    archives = found.select("path") if streamed else found.select("content")
    fields = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                held: list[dict] = []
                for member in members(opened(archive.as_py()) if streamed else archive.as_buffer()):
                    if member:
                        held.append(parse(member))
                    if len(held) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array([x[f] for x in held], k) for f, k in zip(fields, kinds)], fields)
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array([x[f] for x in held], k) for f, k in zip(fields, kinds)], fields)

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
    return archives.mapInArrow(run, schema + ", payload binary" * payloads)


def op7_warc(spark, sf_dir):
    folder = posixpath.join(checkpoint_dir(spark), f"warc-{uuid.uuid4().hex}")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op7_warc": op7_warc}

ORACLE = {
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
        d AS (SELECT *, [strpos('0123456789abcdef', substr(x, i, 1)) - 1 for i in range(1, 41)] AS v FROM q)
        SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((v[5 * i // 4 + 1] * 16 + v[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) & 31)::INT + 1, 1) for i in range(32)], '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d
    """
}
