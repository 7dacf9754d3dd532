"""WARC archives: records written in segments, and put together again by their origin identifier.

Each page becomes a response record with an HTTP head and the payload in chunked transfer framing, or a
revisit record where another page has an equal payload. A block longer than `segment` bytes goes on in
continuation records, which name the first record as their origin, number themselves, and, the last one,
give the total length. Archives are plain or gzip files in the cluster's shared folder, each of `file_bytes`
at most (but for a single record), so that no file grows with the corpus. Reading parses each file by its
records' own lengths; whole records are decoded where they are read, segments are dealt out by origin
identifier, ordered by number, checked against the total length and only then decoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.catalog import shared_folder
from snaplake.llm.common import durable

#: Bytes of a block in one record, of a chunk in the framing, and of records in one file before compression.
SEGMENT, CHUNK, FILE_BYTES = 65_536, 16_384, 8_000_000
#: Payloads shorter than this are never revisits.
LEAST_BYTES = 0
#: Record date and the namespace of record identifiers.
DATE, NAMESPACE = "2024-01-01T00:00:00Z", uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "warc-page:"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out.append(b"%x\r\n%b\r\n" % (len(part), part))
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. ValueError if it is cut short."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + size])
        at += size + 2


def record_id(page: int | None, url: str | None, digest: str, copy: int = 1, number: int = 1) -> str:
    """Tells apart rows of one page, url and payload by copy, and the segments of a record by number."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{PAGE}{page}:{digest}:{copy}:{number}:{url}')}>"


def _record(kind: str, identifier: str, block: bytes, *more: tuple[str, object]) -> bytes:
    """One record but for the last line end, which the writer adds."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", identifier), ("WARC-Date", DATE), *more, ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n"


def page_records(page: int | None, url: str | None, payload: bytes, copy: int = 1, segment: int = SEGMENT, chunk: int = CHUNK) -> list[bytes]:
    """The records of a response: one, or one for each segment."""
    digest = digest32(payload)
    target, common, head = _common(page, url, digest)
    origin, block = record_id(page, url, digest, copy), head + chunked(payload, chunk)
    if len(block) <= segment:
        return [_record("response", origin, block, *common)]
    out = [_record("response", origin, block[:segment], *common, ("WARC-Segment-Number", 1))]
    for number, at in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", len(block))] if at + segment >= len(block) else []
        out.append(_record("continuation", record_id(page, url, digest, copy, number), block[at : at + segment], ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", number), *last))
    return out


def revisit_record(page: int | None, url: str | None, digest: str, copy: int, last_page: int | None, last_url: str | None) -> bytes:
    """The record of a page whose payload the response of another row holds."""
    _, common, head = _common(page, url, digest)
    return _record("revisit", record_id(page, url, digest, copy), head, *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(last_page, last_url, digest)))


def _common(page: int | None, url: str | None, digest: str) -> tuple[str, list[tuple[str, str]], bytes]:
    target = "".join(c for c in url or "" if c > " ") or f"{PAGE}{page}"
    fields = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    known = b"" if page is None else b"X-Page: %d\r\n" % page
    return target, fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n%b\r\n" % known


def parse(archive: bytes):
    """(fields, block) of each record of an archive. ValueError if it is damaged."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if not archive.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, archive[start:stop]
        at = stop + 4


def http_parts(block: bytes) -> tuple[int | None, bytes]:
    """The page number, if there is one, and the payload of a whole HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:])
    return int(fields[b"x-page"]) if b"x-page" in fields else None, unchunked(body) if body else b""


def listed(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(page_id, url, digest, html, copy, last: page_id and url of the response) of the record of every row: a response has html, a revisit none.

    Of rows with an equal payload of at least `least_bytes` the last by page_id (null first) and url is the
    response; a payload goes once through the shuffle. Rows that repeat page, url and payload are its copies.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    short = F.octet_length("html") < least_bytes
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("apart", F.when(short, F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    one = F.struct("page_id", "url")
    responses = rows.groupBy("digest", "apart").agg(F.max(one).alias("last"), F.min("html").alias("html"))
    alike = rows.where(~short).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    # of each payload its response's page: the same rows without the payload
    heads = rows.where(~short).groupBy("digest").agg(F.max(one).alias("last"))
    revisits = alike.join(heads, "digest").withColumn("since", F.when(F.col("page_id").eqNullSafe(F.col("last.page_id")) & F.col("url").eqNullSafe(F.col("last.url")), 2).otherwise(1))
    revisits = revisits.where("n >= since").withColumn("copy", F.explode(F.sequence(F.col("since").cast("long"), F.col("n"))))
    revisits = revisits.select("page_id", "url", "digest", F.lit(None).cast("string").alias("html"), "copy", "last")
    return responses.select("last.page_id", "last.url", "digest", "html", (F.greatest(F.lit(0), "apart") + 1).alias("copy"), "last").unionByName(revisits)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, segment: int = SEGMENT, chunk: int = CHUNK, file_bytes: int = FILE_BYTES, compression: str = "gzip") -> None:
    """Writes all pages as archives into the folder path, a record for every row; other columns don't matter."""

    def records(batches):
        """Archives: records in a row, but for the last line end, which the writer adds."""
        held, n = [], 0
        for batch in batches:
            for page, url, digest, html, copy, last in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "html", "copy", "last"))):
                if html is None:
                    made = [revisit_record(page, url, base64.b32encode(bytes.fromhex(digest)).decode(), copy, last["page_id"], last["url"])]
                else:
                    made = page_records(page, url, html.encode("utf-8", "surrogatepass"), copy, segment, chunk)
                for record in made:
                    if held and n + len(record) > file_bytes:
                        yield (b"\r\n".join(held),)
                        held, n = [], 0
                    held.append(record)
                    n += len(record) + 2
        if held:
            yield (b"\r\n".join(held),)

    work = _in_batches(records, pa.schema([("archive", pa.binary())]), 1)
    lines = listed(pages, id_col, url_col, html_col, least_bytes).mapInArrow(work, "archive binary").select(F.col("archive").cast("string").alias("value"))
    lines.write.mode("errorifexists").option("maxRecordsPerFile", 1).option("lineSep", "\r\n").option("compression", compression).text(path)


def _in_batches(rows, schema: pa.Schema, size: int = 500, most: int = 8_000_000):
    """For mapInArrow: the tuples that rows gives, in batches of `size` rows or about `most` bytes of their binary values."""

    def run(batches):
        held, n = [], 0
        for row in rows(batches):
            held.append(row)
            n += sum(len(v) for v in row if type(v) is bytes)
            if len(held) >= size or n >= most:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, n = [], 0
        if held:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return run


def _plain(content: bytes) -> bytes:
    """An archive file's bytes, decompressed member by member if it is gzip."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(parts)


_WHOLE = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("refers_id", pa.string())])
_WHOLE_SQL = "page_id long, record_id string, record_type string, payload binary, digest string, refers_id string"
_SEGMENT = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("block", pa.binary()), ("digest", pa.string()), ("total", pa.int64())])
_SEGMENT_SQL = "origin string, number long, block binary, digest string, total long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_id, record_type, payload, digest, refers_id) of every response and revisit in the archives of a folder.

    payload: decoded; null for a revisit. A response whose segments don't add up to their total length, or
    whose digest isn't that of its payload, raises ValueError. Records of other kinds are passed over.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def digest_of(fields):
        return fields.get("warc-payload-digest", "").removeprefix("sha1:") or None

    def parsed(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from parse(_plain(content.as_py()))

    def whole(batches):
        for fields, block in parsed(batches):
            kind = fields.get("warc-type")
            if kind in ("response", "revisit") and "warc-segment-number" not in fields:
                page, payload = http_parts(block)
                if kind == "response" and digest_of(fields) != digest32(payload):
                    raise ValueError(f"payload digest of {fields['warc-record-id']} differs")
                yield page, fields["warc-record-id"], kind, payload if kind == "response" else None, digest_of(fields), fields.get("warc-refers-to")

    def segments(batches):
        for fields, block in parsed(batches):
            if "warc-segment-number" in fields and fields.get("warc-type") in ("response", "continuation"):
                yield fields.get("warc-segment-origin-id", fields["warc-record-id"]), int(fields["warc-segment-number"]), block, digest_of(fields), int(fields.get("warc-segment-total-length", -1))

    def joined(batches):
        """Segments come in order of origin and number; one response is held at a time."""
        origin, parts, digest, total = None, [], None, -1

        def closed():
            block = b"".join(parts)
            if total != len(block):
                raise ValueError(f"segments of {origin} have {len(block)} bytes, not {total}")
            page, payload = http_parts(block)
            if digest != digest32(payload):
                raise ValueError(f"payload digest of {origin} differs")
            return page, origin, "response", payload, digest, None

        for batch in batches:
            for o, number, block, d, t in zip(*(batch.column(c).to_pylist() for c in _SEGMENT.names)):
                if o != origin:
                    if origin is not None:
                        yield closed()
                    origin, parts, digest, total = o, [], None, -1
                if number != len(parts) + 1:
                    raise ValueError(f"segment {len(parts) + 1} of {o} is missing")
                parts.append(block)
                digest, total = digest or d, max(total, t)
        if origin is not None:
            yield closed()

    complete = files.mapInArrow(_in_batches(whole, _WHOLE), _WHOLE_SQL)
    dealt = files.mapInArrow(_in_batches(segments, _SEGMENT), _SEGMENT_SQL).repartition("origin").sortWithinPartitions("origin", "number")
    return complete.unionByName(dealt.mapInArrow(_in_batches(joined, _WHOLE), _WHOLE_SQL))


def archived(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to, record_id) of pages, written to archives and read again.

    Every row has a record. Null html is an empty payload; a null id stays null and counts as less than any
    other; of rows that repeat an id and payload one can be the response, the others revisit it. Without a
    path the archives are in a folder of the session's shared one that is removed after reading. No pages: no
    rows.
    """
    spark = pages.sparkSession
    folder = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, **options)
    found = read_archives(spark, folder)
    facts = found.select("page_id", "record_id", "record_type", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "refers_id")
    facts = durable(facts)  # the archives are parsed once
    if path is None:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    known = facts.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("head_bytes"), F.col("payload_digest").alias("head_digest"))
    joined = facts.join(known, "refers_id", "left")
    same = F.col("refers_id").isNull() | F.coalesce(F.col("head_digest") == F.col("payload_digest"), F.lit(False))
    digest = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit's response is missing or another")))
    return joined.select("page_id", "record_type", F.coalesce("payload_bytes", "head_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "refers_to", "record_id")
