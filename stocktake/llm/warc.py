"""WARC records in ZIP packages, and a reader that parses the package instead of unpacking it.

A package stores (method 0) ``archive/data.warc.gz``, one gzip member a record, and
``indexes/index.cdxj``, one JSON line a record with offset and length in the archive. The reader
finds the end-of-central-directory record, the ZIP64 one if there is one, and the central
directory; it checks that a member is stored, skips its local header and range-reads records.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stocktake.llm.shared import joined, open_fs, scratch, shuffle_width, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads shorter than this are never revisits.
LEAST = 100


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without one."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"),
            b"WARC-Record-ID: <urn:page:%s>" % _id(page_id), b"WARC-Date: 1970-01-01T00:00:00Z",
            b"WARC-Target-URI: " + (url or "").encode().replace(b"\r", b"").replace(b"\n", b""),
            b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Bytes: %d" % len(payload)]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%s>" % _id(refers_to)]
    body = b"" if revisit else payload
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def _id(page_id: int | None) -> bytes:
    return b"null" if page_id is None else b"%d" % page_id


def parse_record(data: bytes) -> tuple[str, dict[str, str], bytes]:
    """Type, header fields in lower case, and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = {k.decode().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines[1:])}
    return fields["warc-type"], fields, rest[:int(fields["content-length"])]


class PackageReader:
    """Members of a ZIP file by range reads; only stored members can be read."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        tail_at = max(0, self.size - 65_557 - 20)
        tail = file.read_at(self.size - tail_at, tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, offset = struct.unpack("<HII", tail[end + 10:end + 20])
        if tail[end - 20:end - 16] == b"PK\x06\x07" and end >= 20:
            (at,) = struct.unpack("<Q", tail[end - 12:end - 4])
            big = file.read_at(56, at)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, offset = struct.unpack("<QQQ", big[32:56])
        self.members = dict(self._central(file.read_at(length, offset), count))

    @staticmethod
    def _central(data: bytes, count: int):
        at = 0
        for _ in range(count):
            if data[at:at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, = struct.unpack("<H", data[at + 10:at + 12])
            packed, size, name_n, extra_n, note_n = struct.unpack("<IIHHH", data[at + 20:at + 34])
            (local,) = struct.unpack("<I", data[at + 42:at + 46])
            name = data[at + 46:at + 46 + name_n].decode()
            extra = data[at + 46 + name_n:at + 46 + name_n + extra_n]
            k = 0
            while k + 4 <= len(extra):
                kind, n = struct.unpack("<HH", extra[k:k + 4])
                if kind == 1:  # ZIP64: those of the fields that are all ones, in this order
                    wide, field = iter(struct.unpack(f"<{n // 8}Q", extra[k + 4:k + 4 + n // 8 * 8])), 0xFFFFFFFF
                    size = next(wide) if size == field else size
                    packed = next(wide) if packed == field else packed
                    local = next(wide) if local == field else local
                k += 4 + n
            yield name, (method, packed, local)
            at += 46 + name_n + extra_n + note_n

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin in the package, and how many there are."""
        method, packed, local = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        head = self.file.read_at(30, local)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        name_n, extra_n = struct.unpack("<HH", head[26:30])
        return local + 30 + name_n + extra_n, packed

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        start, size = self.locate(name)
        return self.file.read_at(size - offset if length is None else length, start + offset)

    def records(self):
        """(index entry, record) in index order; each record is one range read."""
        start, _ = self.locate(ARCHIVE)
        for line in self.read(INDEX).decode().splitlines():
            entry = json.loads(line)
            yield entry, parse_record(gzip.decompress(self.file.read_at(entry["length"], start + entry["offset"])))


def write_packages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns (file, n_records).

    Of rows with equal payloads of at least LEAST bytes, the one with the smallest page_id is a
    response and the others revisit it; rows that share that page_id too are responses all. Null
    html is an empty payload; null page_ids are larger than any other; an empty table writes
    nothing; other columns are ignored. A task that is run again writes another file, and only the
    one in the manifest counts.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    first = written(rows.filter(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-first")
    placed = joined(rows, first, "digest", "left").select(  # while repeated payloads are few, html stays where it is read
        "page_id", "url", "html", "digest", "first")

    def write(batches):
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
        system, path = open_fs(uri)
        system.create_dir(folder_path := path.rsplit("/", 1)[0], recursive=True)
        assert folder_path
        n, at, index, package, out, member = 0, 0, [], None, None, None
        for batch in batches:
            ids, firsts, digests = (batch.column(k).to_pylist() for k in (0, 4, 3))
            for k in range(batch.num_rows):
                if package is None:
                    out = system.open_output_stream(path + ".partial")
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = package.open(ARCHIVE, "w", force_zip64=True)
                revisit = firsts[k] is not None and firsts[k] != ids[k]
                data = gzip.compress(record(ids[k], batch.column(1)[k].as_py(), batch.column(2)[k].as_py().encode(), digests[k], firsts[k] if revisit else None, revisit), 1, mtime=0)
                member.write(data)
                index.append(json.dumps({"page": ids[k], "offset": at, "length": len(data)}))
                at += len(data)
                n += 1
        if package is not None:
            member.close()
            package.writestr(INDEX, "\n".join(index))
            package.close()
            out.close()
            system.move(path + ".partial", path)
            yield pa.record_batch([pa.array([uri]), pa.array([n])], names=["file", "n_records"])

    return written(placed.mapInArrow(write, "file string, n_records bigint"), "warc-manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record in the packages.

    A response's figures come from its payload; a revisit's from its header.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    number = lambda urn: None if urn == "null" else int(urn)

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = open_fs(uri)
                rows = []
                with system.open_input_file(path) as file:
                    for _, (kind, fields, body) in PackageReader(file).records():
                        stated = fields["warc-payload-digest"].split(":")[1]
                        page = number(fields["warc-record-id"][len("<urn:page:"):-1])
                        refers = fields.get("warc-refers-to")
                        if kind == "response":
                            digest = hashlib.sha256(body).hexdigest()
                            if digest != stated:
                                raise ValueError(f"{uri}: payload of page {page} does not match its digest")
                        rows.append((page, len(body) if kind == "response" else int(fields["x-payload-bytes"]), stated, kind, number(refers[len("<urn:page:"):-1]) if refers else None, fields["warc-target-uri"]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    return manifest.select("file").repartition(shuffle_width(manifest.sparkSession), "file").mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")
