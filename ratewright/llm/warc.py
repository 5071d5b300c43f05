"""Operator 1, WARC archives as a PySpark data source.

Writing: each record is a gzip member of its own, with its length in the member's extra field; files are rolled at a
size and listed in a manifest when the job commits, so that files of failed attempts are never read.  Reading:
files are planned into partitions by size; of each record only the head is inflated at first, filters on the record
type and other headers are applied to it, and unwanted payloads are skipped by their length without being inflated.
Paths are opened with pyarrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .store import materialize, new_path, small_side

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
MANIFEST = "_MANIFEST.json"
FILE_BYTES = 256 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
HEAD_BYTES = 4096
#: Columns that a filter may be pushed down on.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest"}
EPOCH = "1970-01-01T00:00:00Z"
LEVEL = 3


def file_system(path: str):
    """A pyarrow file system and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(record: dict) -> bytes:
    """One WARC/1.1 record: a response, or a revisit (without payload) if refers_to is given."""
    payload, revisit = record["payload"] or b"", record["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record['record_id']}>"),
        ("WARC-Date", record["date"] or EPOCH),
        ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Payload-Digest", f"sha1:{record['payload_digest'] or sha1_base32(payload)}"),
        ("WARC-Refers-To", f"<{record['refers_to']}>" if revisit else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field 'sl' holds the lengths of the member and of the data."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_head(head: bytes) -> tuple[dict[str, str], int]:
    """The header fields (lower-case names) of a record and where its block starts."""
    end = head.index(b"\r\n\r\n")
    lines = head[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}, end + 4


class _Member:
    """A record of an open file: its head at once, the rest on demand."""

    def __init__(self, file, start: int, compressed: bool):
        self.file, self.start, self.length = file, start, None
        file.seek(start)
        self.inflate = zlib.decompressobj(31) if compressed else None
        raw = file.read(HEAD_BYTES)
        self.data = b""
        if compressed and len(raw) >= 24 and raw[3] & 4 and raw[12:14] == b"sl":
            self.length = struct.unpack("<I", raw[16:20])[0]
        if raw:
            self._take(raw)
            while b"\r\n\r\n" not in self.data and (raw := file.read(HEAD_BYTES)):
                self._take(raw)

    def _take(self, raw: bytes) -> None:
        self.data += self.inflate.decompress(raw) if self.inflate else raw

    def upto(self, size: int) -> bytes:
        """The first ``size`` bytes of the record."""
        while len(self.data) < size and not (self.inflate and self.inflate.eof):
            raw = self.file.read(max(HEAD_BYTES, min(size - len(self.data), 1 << 20)))
            if not raw:
                break
            self._take(raw)
        if len(self.data) < size:
            raise EOFError(f"the record at {self.start} is cut short")
        return self.data[:size]

    def end(self, size: int) -> int:
        """Where the next record starts."""
        if self.inflate is None:
            return self.start + size
        if self.length is not None:
            return self.start + self.length
        while not self.inflate.eof and (raw := self.file.read(1 << 16)):
            self.inflate.decompress(raw)
        return self.file.tell() - len(self.inflate.unused_data)


def records(file, wanted, payload: bool, verify: bool):
    """Tuples in the order of SCHEMA of the records whose headers ``wanted`` accepts."""
    at, total = 0, file.size()
    while at < total:
        file.seek(at)
        compressed = file.read(2) == b"\x1f\x8b"
        member = _Member(file, at, compressed)
        head, start = parse_head(member.data)
        size = start + int(head["content-length"]) + 4
        if wanted(head):
            kind, revisit = head.get("warc-type"), head.get("warc-type") == "revisit"
            digest = (head.get("warc-payload-digest") or "").rpartition(":")[2] or None
            block = member.upto(size - 4)[start:] if payload or verify or revisit else None
            body, length = None, None
            if block is not None:
                http, _, body = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
                declared = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                length = int(declared[0]) if revisit and declared else len(body)
                if verify and not revisit and digest is not None and sha1_base32(body) != digest:
                    raise ValueError(f"{head.get('warc-record-id')}: the payload does not have the digest {digest}")
            refers = head.get("warc-refers-to")
            yield (head.get("warc-record-id", "").strip("<>"), kind, head.get("warc-target-uri"), head.get("warc-date"), refers and refers.strip("<>"), digest, length, body if payload and not revisit else None)
        at = member.end(size)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.tests: list[tuple[str, str, tuple]] = []
        if types := options.get("record_types"):
            self.tests.append(("warc-type", "in", tuple(types.split(","))))

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in (None, "warc-record-id", "warc-payload-digest"):
                yield f  # their values are stored in brackets or with a prefix
            elif isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", (f.value,)))
            else:
                yield f

    def _files(self) -> list[tuple[str, int]]:
        system, path = file_system(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        manifest = f"{path}/{MANIFEST}"
        if system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as f:
                return [(f"{path}/{x['file']}", x["bytes"]) for x in json.load(f)]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [(x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        room = 0
        for path, size in sorted(self._files(), key=lambda x: (-x[1], x[0])):
            if room < size or not out:
                out.append(Files([]))
                room = PARTITION_BYTES
            out[-1].paths.append(path)
            room -= size
        return out or [Files([])]

    def read(self, partition: Files):
        system, _ = file_system(self.path)

        def wanted(head: dict) -> bool:
            return all((v := head.get(k)) is not None and (v in x if how == "in" else v.startswith(x)) for k, how, x in self.tests)

        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for row in records(file, wanted, self.payload, self.verify):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


_TYPES = [pa.string()] * 6 + [pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator) -> Written:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        files: list[tuple[str, int, int]] = []
        out, size, count = None, 0, 0
        for batch in iterator:
            for record in batch.to_pylist():
                if out is None:
                    name, size, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                member = gzip_member(encode_record(record))
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= self.limit:
                    out.close()
                    files.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size, count))
        return Written(files)

    def commit(self, messages) -> None:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        listed = [{"file": n, "bytes": b, "records": c} for m in messages if m for n, b, c in m.files]
        with system.open_output_stream(f"{path}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages) -> None:
        system, path = file_system(self.path)
        for m in messages:
            for name, _, _ in m.files if m else []:
                system.delete_file(f"{path}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")`` after registration.

    Options: path; reading: payload (false: payloads are not returned), verify (payload digests are checked),
    record_types (comma-separated); writing: file_bytes.  payload_length is null where the block was not inflated.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_warc(rows: DataFrame, path: str) -> None:
    """Write rows with the columns of SCHEMA (any order; payload_length is not used) to a new folder."""
    register(rows.sparkSession)
    rows.select(*_NAMES).write.format("warc").mode("append").option("path", path).save()


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records of a file or folder; filters on record_type, target_uri and date reach the headers."""
    register(spark)
    return spark.read.format("warc").options(**options).option("path", path).load()


def revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``rows`` (id, payload binary, ...) with digest and leader: the largest id of a row with an equal payload.

    leader is null for payloads under ``min_bytes`` and where no other row has the payload.  Payloads are
    compared by SHA-1 and length.
    """
    keyed = rows.select("*", F.concat(F.sha1("payload"), F.octet_length("payload").cast("string")).alias("_key"))
    small = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("_key").agg(F.max("id").alias("leader"), F.count("*").alias("_n"))
    leaders = materialize(small.where("_n > 1").select(F.col("_key").alias("_lead"), "leader"), "leaders")
    return keyed.join(small_side(leaders), F.col("_key") == F.col("_lead"), "left").drop("_key", "_lead")


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write a record for each page (page_id, url, html) and read the archives back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to.  Of pages with equal payloads of at
    least ``min_bytes`` bytes the one with the largest page_id is a response, the others revisit it; rows equal in
    page_id and payload are alike.  A null html is an empty payload, a null url leaves the header out; rows with a
    null page_id are written under an empty id and come back with a null one; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    led = revisits(rows, min_bytes)
    refers = F.when(F.col("leader").isNotNull() & ~F.col("id").eqNullSafe(F.col("leader")), F.concat(F.lit("urn:page:"), F.col("leader").cast("string")))
    base32 = _base32(F.sha1("payload"))
    records_ = led.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(EPOCH).alias("date"),
        refers.alias("refers_to"),
        base32.alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.col("payload"),
    )
    write_warc(records_, path)
    back = read_warc(spark, path, payload="false", verify="true")
    id_of = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    return back.select(
        id_of(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        id_of(F.col("refers_to")).alias("refers_to"),
    )


def _base32(hexed):
    """Base32 of 40 hex digits: every five digits make four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    group = lambda k: F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
    letter = lambda n, s: F.substring(letters, F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, 1)
    return F.concat(*[letter(group(k), s) for k in range(8) for s in (15, 10, 5, 0)])


def archive_to_shared(pages: DataFrame) -> DataFrame:
    """:func:`archive_pages` into a new folder of the shared one."""
    return archive_pages(pages, new_path(pages.sparkSession, "warc"))
