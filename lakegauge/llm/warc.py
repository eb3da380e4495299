"""WARC archives: written through Spark's text sink, read back with segments put together.

A page is a ``response`` record, whose block is an HTTP message in chunked
transfer framing; of pages with equal payloads the one with the smallest id is
stored and the others are ``revisit`` records that refer to it.  A block longer
than a segment goes on in ``continuation`` records.  Reading groups these by the
record they continue, orders them by number, verifies the total length, takes
the chunk framing off, and verifies the payload's digest.

The text sink ends each row with CR LF, which with a CR LF of our own is the end
of a WARC record; files are compressed by the sink and read whole as binary
files, so writing and reading go where Spark can reach.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakegauge.llm.common import new_path, written

CRLF = b"\r\n"
#: Bytes of a block before it goes on in another record.
SEGMENT_BYTES = 16 << 10
#: Bytes of a chunk of the HTTP message.
CHUNK_BYTES = 4 << 10
#: Bytes of an archive file before compression, about; a file is read as one value.
FILE_BYTES = 128 << 20
#: Payloads shorter than this are stored again rather than referred to.
LEAST_REVISIT = 0
#: Records carry the time of the archive's making, fixed so that reruns agree.
DATE = "2026-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked message body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record up to the last CR LF, which the sink adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF


def _url(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c) & 0xFF:02X}" for c in url or "")


def response_records(page_id: str, url: str | None, payload: bytes, digest: str, segment: int, copy: str = "") -> Iterator[bytes]:
    """A response and its continuations; ``copy`` tells records of one page and payload apart."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + chunked(payload)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    name = f"urn:page:{page_id}:{digest}{copy}"
    origin = f"<{name}>"
    for k, piece in enumerate(pieces, 1):
        fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Date", DATE), ("WARC-Target-URI", _url(url))]
        fields.append(("WARC-Record-ID", origin if k == 1 else f"<{name}:{k}>"))
        if k == 1:
            fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
        if len(pieces) > 1:
            fields.append(("WARC-Segment-Number", str(k)))
            if k > 1:
                fields.append(("WARC-Segment-Origin-ID", origin))
            if k == len(pieces):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(fields, piece)


def revisit_record(page_id: str, url: str | None, first: str, digest: str, copy: str = "") -> bytes:
    fields = [
        ("WARC-Type", "revisit"), ("WARC-Date", DATE), ("WARC-Target-URI", _url(url)), ("WARC-Record-ID", f"<urn:page:{page_id}:{digest}{copy}>"),
        ("WARC-Refers-To", f"<urn:page:{first}:{digest}>"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_revisit: int = LEAST_REVISIT, segment: int = SEGMENT_BYTES,
) -> None:
    """Write a record for each row of ``pages`` to ``path``, gzip-compressed.

    A null payload is empty.  Records are named after page and payload, so that
    rows of one id and different payloads stay apart; rows that agree in both are
    a record each, numbered in their task (equal records of different tasks share
    a name, and reading counts them), and of the smallest id all are responses.  A null id is written as ``null`` and counts as larger than any
    other.  An empty table writes no record.  Files end after so many records
    that none is larger than ``FILE_BYTES`` uncompressed.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    longer = F.octet_length("html") >= least_revisit
    firsts = rows.where(longer).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    alone = F.lit(least_revisit <= 0) & (F.col("rows") == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [record([("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Record-ID", "<urn:info>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")]
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            columns = [batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3), batch.column(4), batch.column(5)]
            for key, url, html, first, raw, alone in zip(*(c.to_pylist() for c in columns)):
                digest, name, copy = base64.b32encode(raw).decode(), "null" if key is None else str(key), ""
                if not alone:  # the same page and payload may come again
                    seen[name, raw] += 1
                    copy = f":{part}-{seen[name, raw]}" if seen[name, raw] > 1 else ""
                if first is not None and first != key:
                    out.append(revisit_record(name, url, str(first), digest, copy))
                else:
                    out += response_records(name, url, html, digest, segment, copy)
                if sum(map(len, out[-64:])) > 1 << 20 or len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (
        rows.join(firsts, "digest", "left").select("id", "url", "html", "first", "digest", F.coalesce(alone, F.lit(False)).alias("alone"))
        .mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\r\n").option("compression", "gzip")
        .option("maxRecordsPerFile", max(1, FILE_BYTES // (segment + 4096))).text(path)
    )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of every record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].split(CRLF)[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode()] = v.strip().decode()
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, data[start:stop]
        at = stop + 4


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP message, its transfer framing taken off."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(CRLF)[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == b"transfer-encoding" and v.strip().lower() == b"chunked":
            return unchunked(body)
    return body


def _verified(block: bytes, digest: str | None) -> tuple[bytes, str]:
    payload = http_payload(block)
    own = base32_sha1(payload)
    if digest and digest != own:
        raise ValueError(f"payload digest {own} differs from the record's {digest}")
    return payload, own


_NAMES = ["origin", "number", "total", "url", "digest", "refers_to", "record_type", "block", "payload"]
_KINDS = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary()]
_SCHEMA = (
    "origin string, number int, total long, url string, digest string, refers_to string, record_type string, "
    "block binary, payload binary"
)


def _segments(files: DataFrame) -> DataFrame:
    """A row per record: whole responses with their payload, parts of others with their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)

        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                rows, held = [], 0
                for f, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind = f["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                    total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                    origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                    payload = None
                    if number is None and kind == "response":
                        payload, digest = _verified(block, digest)
                    rows.append((origin, number, total, f.get("warc-target-uri"), digest, f.get("warc-refers-to"), kind, block if number else None, payload))
                    held += len(block)
                    if held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    return files.mapInArrow(run, _SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (origin, url, record_type, refers_to, payload, payload_digest): pages and revisits of the archives at ``path``.

    Revisits have no payload of their own.  A missing segment, a wrong total
    length, a bad chunk or a digest that does not match is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    parts = _segments(files)
    whole = parts.where("number is null").select("origin", "url", "record_type", "refers_to", "payload", F.col("digest").alias("payload_digest"))
    pieces = parts.where("number is not null").groupBy("origin").agg(
        F.max("total").alias("total"), F.max("digest").alias("digest"), F.max(F.when(F.col("number") == 1, F.col("url"))).alias("url"),
        F.collect_list(F.struct("number", "block")).alias("pieces"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                pieces = {p["number"]: p["block"] for p in one["pieces"]}
                block = b"".join(pieces[k] for k in sorted(pieces))
                if sorted(pieces) != list(range(1, len(pieces) + 1)) or len(block) != one["total"]:
                    raise ValueError(f"{one['origin']}: {len(block)} bytes in segments {sorted(pieces)}, not {one['total']}")
                payload, digest = _verified(block, one["digest"])
                # equal rows that different tasks have written are equal records
                copies, rest = divmod(len(one["pieces"]), len(pieces))
                if rest:
                    raise ValueError(f"{one['origin']}: {len(one['pieces'])} segments of {len(pieces)} numbers")
                values = [one["origin"], one["url"], "response", None]
                arrays = [pa.array([v] * copies, pa.string()) for v in values] + [pa.array([payload] * copies, pa.binary()), pa.array([digest] * copies)]
                yield pa.RecordBatch.from_arrays(arrays, ["origin", "url", "record_type", "refers_to", "payload", "payload_digest"])

    together = pieces.mapInArrow(join, "origin string, url string, record_type string, refers_to string, payload binary, payload_digest string")
    return whole.union(together)


def record_facts(records: DataFrame) -> DataFrame:
    """Rows (origin, url, record_type, refers_to, payload_bytes, payload_digest); a revisit has those of its response."""
    own = written(records.select("origin", "url", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest"), "records")
    stored = own.where("record_type = 'response'").groupBy("origin").agg(
        F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("stored_digest")
    )
    visits = own.where("record_type = 'revisit'").join(stored.withColumnRenamed("origin", "stored"), F.col("refers_to") == F.col("stored"))
    agreed = F.when(F.col("payload_digest") == F.col("stored_digest"), F.col("bytes")).otherwise(
        F.raise_error(F.concat(F.lit("revisit of another payload: "), F.col("origin"))).cast("long")
    )
    return own.where("record_type = 'response'").union(
        visits.select("origin", "url", "record_type", "refers_to", agreed.alias("payload_bytes"), "payload_digest")
    )


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read their records back."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
