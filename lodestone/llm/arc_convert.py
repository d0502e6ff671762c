"""Legacy archive converter: ARC files to WARC files.

An ARC file starts with a `filedesc:` record that names its version; the version fixes the fields of every header line
(five in version 1, ten in version 2), whose last field declares the length of the block that follows. Each record
becomes a WARC record with an identifier made from its page, the ISO form of its date, a type and SHA-1 digests. Of
records with equal payloads of at least `least` bytes the one with the smallest page id is a response, the others are
revisits that name it; their blocks hold the HTTP header alone.

Archives are written by Spark's text sink, one file of about `segment` bytes a row (a larger record has a file of its
own), and read as binary files, so any store that Spark knows serves. Null payloads are empty; a null URL becomes
`urn:page:<id>`; spaces in URLs are percent-encoded; rows with equal page ids and payloads are responses all; rows
without a page id revisit the record of the smallest id, and are responses all where no equal payload has one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir

# The header fields of the two ARC versions.
FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length".split(),
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
SEGMENT = 8 << 20
DATE = "20240101000000"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _arc_writer(version: str, segment: int):
    def head() -> bytes:
        body = f"{version} 0 lodestone\n{' '.join(FIELDS[version])}\n".encode()
        return line("filedesc://pages.arc", "text/plain", body) + body

    def line(url: str, kind: str, block: bytes) -> bytes:
        v = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "pages.arc", "Archive-length": str(len(block))}
        return (" ".join(v[f] for f in FIELDS[version]) + "\n").encode()

    def run(batches):
        out, n = [head()], 0
        for b in batches:
            for i, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                url = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{i}"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if i is None else i}\r\n\r\n".encode() + (html or "").encode()
                out.append(line(url, "text/html", block) + block)
                n += len(block)
                if n >= segment:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(out)], pa.binary()).cast(pa.string())], ["value"])
                    out, n = [head()], 0
        if len(out) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(out)], pa.binary()).cast(pa.string())], ["value"])

    return run


def write_arc(pages: DataFrame, path: str, version: str = "1", segment: int = SEGMENT) -> None:
    rows = pages.select("page_id", "url", "html").mapInArrow(_arc_writer(version, segment), "value string")
    rows.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def arc_records(content: bytes):
    """(header fields, block) of each record after the file's own description."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            break
        words = data[at:end].decode().split(" ")
        if words == [""]:
            at = end + 1
            continue
        size = int(words[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError(f"a record declares {size} bytes, {len(block)} are left")
        if fields is None:
            if not words[0].startswith("filedesc:"):
                raise ValueError("the first record isn't a filedesc")
            fields = FIELDS[block.split(b" ", 1)[0].decode()]
        elif len(words) != len(fields):
            raise ValueError(f"{len(words)} header fields, {len(fields)} expected")
        else:
            yield dict(zip(fields, words)), block
        at = end + 1 + size + 1


def _split(block: bytes) -> tuple[bytes, bytes, int | None]:
    """(HTTP header, payload, page id) of a record's block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    found = [x.split(b":", 1)[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")]
    return head + b"\r\n\r\n", payload, int(found[0]) if found and found[0] else None


def _slim(batches):
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
            rows = [(path, i, p, len(y), digest(y)) for i, (_, block) in enumerate(arc_records(content)) for _, y, p in [_split(block)]]
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4])], ["path", "pos", "page_id", "n", "digest"])


def _record_id(page: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}' if page is not None else url)}>"


def _warc(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


def _convert(batches):
    for b in batches:
        for path, content, found in zip(*(b.column(c).to_pylist() for c in ("path", "content", "revisits"))):
            first = {r["pos"]: r["first"] for r in found or []}
            iso = f"{DATE[:4]}-{DATE[4:6]}-{DATE[6:8]}T{DATE[8:10]}:{DATE[10:12]}:{DATE[12:]}Z"
            info = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"
            out = [_warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, path)), ("WARC-Date", iso), ("Content-Type", "application/warc-fields")], info)]
            for i, (h, block) in enumerate(arc_records(content)):
                d = h["Archive-date"].ljust(14, "0")
                head, payload, page = _split(block)
                kind = "revisit" if i in first else "response"
                kept = head if i in first else block
                fields = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page, h["URL"])), ("WARC-Target-URI", h["URL"]), ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"), ("WARC-IP-Address", h["IP-address"])]
                fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(kept)}"), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response")]
                if i in first:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(first[i], "")), ("X-Refers-To-Page", first[i])]
                out.append(_warc(fields, kept))
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(out)], pa.binary()).cast(pa.string())], ["value"])


def convert(spark, arc: str, warc: str, least: int = 0) -> None:
    """Write the WARC files of all ARC files in a folder."""
    files = spark.read.format("binaryFile").load(arc).select("path", "content")
    slim = files.mapInArrow(_slim, "path string, pos int, page_id long, n long, digest string").filter(F.col("n") >= least)
    first = slim.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    again = slim.join(first, ["digest", "n"]).filter("first is not null and (page_id is null or page_id <> first)").groupBy("path").agg(F.collect_list(F.struct("pos", "first")).alias("revisits"))  # at most one file's records
    rows = files.join(again, "path", "left").select("path", "content", "revisits").mapInArrow(_convert, "value string")
    rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).option("compression", "gzip").text(warc)


def warc_records(content: bytes):
    """(header fields, block) of each record."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC version line")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_date string, record_id string"


def _read(batches):
    for b in batches:
        for content in b.column("content").to_pylist():
            rows = []
            for f, block in warc_records(content):
                if f["WARC-Type"] not in ("response", "revisit"):
                    continue
                _, payload, page = _split(block)
                if digest(block) != f["WARC-Block-Digest"].removeprefix("sha1:"):
                    raise ValueError(f"{f['WARC-Record-ID']}: its block doesn't match its digest")
                full = f["WARC-Type"] == "response"
                rows.append((page, len(payload) if full else int(f["X-Payload-Length"]), digest(payload) if full else f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], int(f["X-Refers-To-Page"]) if "X-Refers-To-Page" in f else None, f["WARC-Date"], f["WARC-Record-ID"]))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k in (0, 1, 4) else pa.string()) for k, x in enumerate(c)], [x.split()[0] for x in RECORD.split(", ")])


def read_warc(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, RECORD)


def query(pages: DataFrame, version: str = "1") -> DataFrame:
    spark = pages.sparkSession
    at = f"{shared_dir(spark)}/lodestone-archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{at}/arc", version)
    convert(spark, f"{at}/arc", f"{at}/warc")
    return read_warc(spark, f"{at}/warc")
