"""Web archives: legacy ARC records converted to WARC, written and read with Spark.

``arc_records`` reads ARC bytes by their version's header lines and declared lengths,
``read_arc`` whole files of them as streams of lines.
``to_warc`` gives each record the WARC fields that ARC lacks: identifier, time stamp,
type and digest.  ``write_warc`` stores records through Spark's text writer (a record's
two closing line ends are the line separator, so files are byte-exact WARC, committed
like any Spark output, on any file system), ``read_warc`` reads them back by their
declared lengths, as a stream: a task holds one record at a time, whatever a file's size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header fields of a URL record by version, as the ARC format fixes them.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "mime", "length"),
    "2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
_ARC_NAMES = {"URL": "url", "IP-address": "ip", "Archive-date": "date", "Content-type": "mime", "Result-code": "status", "Checksum": "checksum", "Location": "location", "Offset": "offset", "Filename": "filename", "Archive-length": "length"}
RECORD_SCHEMA = "url string, ip string, date string, mime string, status string, block binary"
WARC_SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, http_header binary, payload binary"
READ_SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, http_header binary, payload binary, headers map<string,string>"


def _described(block: bytes) -> tuple[str, ...]:
    """The header fields that a version block names, else those of its version."""
    rows = block.decode("utf-8", "replace").splitlines()
    named = tuple(_ARC_NAMES.get(x) for x in rows[1].split()) if len(rows) > 1 else ()
    return named if named and all(named) else ARC_FIELDS[rows[0].split()[0]]


def _record(line: list[str], fields: tuple[str, ...] | None, block: bytes) -> dict:
    kind = fields or (ARC_FIELDS["2"] if len(line) >= len(ARC_FIELDS["2"]) else ARC_FIELDS["1"])
    spare = len(line) - len(kind)  # a content type may hold blanks
    if spare > 0:
        i = kind.index("mime")
        line[i : i + spare + 1] = [" ".join(line[i : i + spare + 1])]
    out = dict(zip(kind, line, strict=True)) | {"block": block}
    return {k: out.get(k) for k in ("url", "ip", "date", "mime", "status", "block")}


def arc_records(data: bytes) -> Iterator[dict]:
    """The URL records of one ARC archive, or of a run of its records.

    The version block (``filedesc:``), where there is one, names the version and the
    header fields of what follows. Without it a header line's number of fields tells the
    version. Blank lines between records are skipped; a block is as long as declared.
    """
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line at byte {at} has no end")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        length = int(line[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"ARC record at byte {at} declares {length} bytes and has {len(block)}")
        at = end + 1 + length
        if line[0].startswith("filedesc:"):
            fields = _described(block)
            continue
        yield _record(line, fields, block)


def arc_stream(lines: Iterable[tuple[int, bytes]]) -> Iterator[dict]:
    """The URL records of ARC files that come line by line, without line ends, each line with a
    number of its file. One record is held at a time; a line end may be missing at a file's end."""
    held, fields, head, need, now = bytearray(), None, None, 0, None
    for file, text in lines:
        if file != now:
            if head is not None:
                raise ValueError(f"the ARC record of {head[0]} declares {need} bytes and has {len(held)}")
            held, fields, now = bytearray(), None, file
        if head is None:
            line = text.rstrip(b"\r")
            if line:
                head = line.decode("utf-8", "replace").split(" ")
                need = int(head[-1])
        else:
            held += text
            held += b"\n"
        if head is not None and len(held) >= need:
            block, rest = bytes(held[:need]), held[need:].strip(b"\r\n")
            if rest:  # a block ends within a line only where the line end after it is missing
                raise ValueError(f"the ARC record of {head[0]} contradicts its declared length {need}")
            if head[0].startswith("filedesc:"):
                fields = _described(block)
            else:
                yield _record(head, fields, block)
            held, head = bytearray(), None
    if head is not None:
        raise ValueError(f"the ARC record of {head[0]} declares {need} bytes and has {len(held)}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _split(block: bytes, url: str) -> tuple[bytes, bytes]:
    """The HTTP header (with its closing blank line) and the payload of a record's block."""
    if not url.lower().startswith(("http:", "https:")) and not block.startswith(b"HTTP/"):
        return b"", block
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def warc_fields(record: dict) -> dict:
    """The WARC equivalents of one ARC record.

    The identifier is a name-based UUID of address, time and digest, so that a repeated
    conversion gives the same one. A time stamp of fewer than 14 digits is filled up with
    the earliest time it can mean. Records with an HTTP header are responses, others
    resources. The digest is the bare base32 SHA-1 of the payload.
    """
    header, payload = _split(record["block"], record["url"])
    d = re.sub(r"\D", "", record["date"] or "")[:14]
    d = (d + "00000101000000"[len(d) :]) if len(d) < 14 else d
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    digest = digest_of(payload)
    name = f"{record['url']} {d} {digest} {hashlib.sha1(header).hexdigest()}"
    return {"record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "record_type": "response" if header else "resource", "target_uri": record["url"], "date": date, "payload_digest": digest, "refers_to": None, "http_header": header, "payload": payload}


def _rows(records: Iterator[dict], names: list[str], types: list[pa.DataType], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in records:
        out.append(r)
        size += len(r.get("payload") or r.get("block") or b"") + 500
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], t) for n, t in zip(names, types, strict=True)], names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], t) for n, t in zip(names, types, strict=True)], names)


_STRING, _BINARY = pa.string(), pa.binary()
_WARC_NAMES = ["record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "http_header", "payload"]
_WARC_TYPES = [_STRING] * 6 + [_BINARY] * 2


def to_warc(archives: DataFrame, content: str = "content") -> DataFrame:
    """One row of WARC fields for each record of the ARC bytes in ``content``.

    Null and empty archives have no records. A header line or block that contradicts its
    declared length is an error, as nothing after it can be trusted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = (x.as_py() for x in batch.column(0))
            yield from _rows((warc_fields(r) for b in blobs if b for r in arc_records(b)), _WARC_NAMES, _WARC_TYPES)

    return archives.select(F.col(content).cast("binary").alias("content")).mapInArrow(run, WARC_SCHEMA)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """WARC fields of all records in the ARC files at ``path``, plain or ``.gz`` (one member or many).

    Files come as lines through Spark's text reader and are put together by declared lengths:
    a task holds one record, whatever a file's size. A compressed file is one task's stream;
    the lines of plain files, which Spark may cut, are brought together and sorted by file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").endswith(".gz").alias("zipped"), F.col("_metadata.file_block_start").alias("start"))
    plain = lines.where("NOT zipped").withColumn("place", F.monotonically_increasing_id()).repartition("file").sortWithinPartitions("file", "start", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((f.as_py(), v.as_py()) for batch in batches for f, v in zip(batch.column(0), batch.column(1), strict=True))
        yield from _rows((warc_fields(r) for r in arc_stream(each)), _WARC_NAMES, _WARC_TYPES)

    streamed = lines.where("zipped").select("file", "value").mapInArrow(run, WARC_SCHEMA)
    return streamed.unionByName(plain.select("file", "value").mapInArrow(run, WARC_SCHEMA))


def mark_revisits(records: DataFrame, order: str, *, digest: str = "payload_digest") -> DataFrame:
    """Of the records with one digest, all but those with the largest ``order`` become
    revisits: record_type, refers_to (its identifier) and refers_to_order are set.

    Only digests that occur twice or more are joined back, so the rows of a hot digest
    are spread by Spark's skewed join; its group is reduced to one row beforehand.
    """
    best = records.groupBy(F.col(digest).alias("__digest")).agg(F.max(F.struct(F.col(order).alias("o"), F.col("record_id").alias("i"))).alias("__best"), F.count("*").alias("__n")).where("__n > 1")
    joined = records.join(best, records[digest] == best["__digest"], "left")
    again = F.col("__best").isNotNull() & ~F.col(order).eqNullSafe(F.col("__best.o"))
    out = joined.withColumn("record_type", F.when(again, "revisit").otherwise(F.col("record_type"))).withColumn("refers_to", F.when(again, F.col("__best.i")))
    return out.withColumn("refers_to_order", F.when(again, F.col("__best.o"))).drop("__digest", "__best", "__n")


def write_warc(records: DataFrame, path: str, *, extra: dict[str, str] | None = None, records_per_file: int = 20_000) -> None:
    """Write records as gzip WARC files; ``extra`` maps more header names to columns.

    A revisit has its HTTP header but no payload. Files hold at most ``records_per_file``.
    """
    block = F.when(F.col("record_type") == "revisit", F.col("http_header")).otherwise(F.concat("http_header", "payload"))
    media = F.when(F.length("http_header") == 0, "application/octet-stream").otherwise("application/http; msgtype=response")
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        *[F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in (extra or {}).items()],
        F.concat(F.lit("Content-Type: "), media),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    value = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block.cast("string"))
    records.select(value.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_END = b"\r\n\r\n"


def warc_records(chunks: Iterable[bytes]) -> Iterator[dict]:
    """The records of WARC files by their declared lengths.

    ``chunks`` are the files' bytes in order, cut at (and without) each blank line; a
    block that holds blank lines is put together again up to its declared length.
    """
    chunks, held = iter(chunks), bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            held.extend(chunk)
            held.extend(_END)
        return True

    while fill(1):
        lead = len(held) - len(held.lstrip(b"\r\n"))
        if lead:  # line ends between records
            del held[:lead]
            continue
        end = held.find(_END)
        first, *lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines if ": " in x)
        length = int(headers["Content-Length"])
        at = end + len(_END)
        if not fill(at + length + len(_END)) or held[at + length : at + length + len(_END)] != _END:
            raise ValueError(f"WARC record {headers.get('WARC-Record-ID')} contradicts its declared length {length}")
        block = bytes(held[at : at + length])
        del held[: at + length + len(_END)]
        header, payload = _split(block, headers.get("WARC-Target-URI", ""))
        digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        if headers["WARC-Type"] != "revisit" and digest and digest_of(payload) != digest:
            raise ValueError(f"payload of {headers.get('WARC-Record-ID')} contradicts its digest")
        yield {"record_id": headers.get("WARC-Record-ID"), "record_type": headers["WARC-Type"], "target_uri": headers.get("WARC-Target-URI"), "date": headers.get("WARC-Date"), "payload_digest": digest, "refers_to": headers.get("WARC-Refers-To"), "http_header": header, "payload": payload, "headers": list(headers.items())}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the gzip WARC files at ``path``, in one member or one for each record;
    payload digests are checked. A compressed file is read by one task, as a stream."""
    chunks = spark.read.option("lineSep", _END.decode()).text(path).select(F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (x.as_py() for batch in batches for x in batch.column(0))
        yield from _rows(warc_records(each), [*_WARC_NAMES, "headers"], [*_WARC_TYPES, pa.map_(_STRING, _STRING)])

    return chunks.mapInArrow(run, READ_SCHEMA)


def legacy_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> DataFrame:
    """Each page as the bytes of one ARC record (``content``), version 1 and 2 in turn.

    A null page is an empty payload. An address is null or holds white space: a made-up
    one with the page's id, or the white space percent-encoded, as the header line
    separates fields by blanks.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), key, F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    block = F.concat(header, payload)
    url = F.coalesce(F.regexp_replace(F.nullif(F.col(url_col), F.lit("")), r"[\s\x00-\x1F]", "%20"), F.concat(F.lit("http://page.invalid/"), key))
    length = F.octet_length(block).cast("string")
    first = F.concat(url, F.lit(f" 0.0.0.0 {date} text/html "), length)
    second = F.concat(url, F.lit(f" 0.0.0.0 {date} text/html 200 - - 0 - "), length)
    line = F.when(F.coalesce(F.col(id_col) % 2 == 0, F.lit(True)), first).otherwise(second)
    return pages.select(F.concat(F.concat(line, F.lit("\n")).cast("binary"), block, F.lit("\n").cast("binary")).alias("content"))


def archive_pages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Convert pages from legacy records to WARC files at ``path`` and read those back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri,
    warc_date, record_id, one row per page. Of pages with equal payloads (of 0 bytes too)
    those with the largest id are responses, the others revisit them; a null id is smaller
    than any other and comes back as null. Empty tables give an empty archive; other
    columns are ignored.
    """
    number = F.regexp_extract(F.decode("http_header", "UTF-8"), r"\r\nX-Page-Id: (-?\d*)\r\n", 1)
    records = to_warc(legacy_records(pages, id_col=id_col, url_col=url_col, html_col=html_col)).withColumn("page_id", F.nullif(number, F.lit("")).cast("long"))
    write_warc(mark_revisits(records, "page_id"), path, extra={"X-Refers-To-Page-Id": "refers_to_order"})
    back = read_warc(pages.sparkSession, path)
    length = F.regexp_extract(F.decode("http_header", "UTF-8"), r"\r\nContent-Length: (\d+)\r\n", 1)
    return back.select(
        F.nullif(number, F.lit("")).cast("long").alias("page_id"), length.cast("long").alias("payload_bytes"), "payload_digest", "record_type",
        F.try_element_at("headers", F.lit("X-Refers-To-Page-Id")).cast("long").alias("refers_to"), "target_uri", F.col("date").alias("warc_date"), "record_id",
    )
