"""WARC archives as a Spark data source, and page archives with revisit records.

``spark.read.format("warc")`` plans one partition per archive file, pushes
equality and IN predicates on record types and headers into the scan, parses a
record's headers first, and inflates a payload only when a wanted record's
payload is asked for by the schema. Each record is a gzip member of its own; the
writer notes the member's length in the gzip header, so that unwanted payloads
are stepped over. Archives of other writers, plain or gzip, are read as well,
those without the note by inflating through them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from webweft.runtime import materialize, scratch_path

#: Columns of the source; a read may name any subset of them in its schema.
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes long, content_type string, content_length long, payload binary"
)
HEADER_OF = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "payload_bytes": "x-payload-bytes",
    "content_type": "content-type", "content_length": "content-length",
}
PAGE_URN = "urn:webweft:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

#: Revisiting pages up to which their ids are broadcast to the payloads; more are joined.
BROADCAST_REVISITS = 500_000

_CHUNK = 1 << 20
_GZIP = struct.Struct("<2sBBIBB")
_NOTE = b"ww"  # gzip subfield: length of the whole member
_FIXED = 10 + 2 + 8


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes, level: int) -> bytes:
    """``data`` as a gzip member whose header says how long the member is."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = _FIXED + len(body) + 8
    if size >= 1 << 32:  # beyond the note's four bytes: a plain member, which readers inflate through
        return _GZIP.pack(b"\x1f\x8b", 8, 0, 0, 0, 255) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    head = _GZIP.pack(b"\x1f\x8b", 8, 4, 0, 0, 255) + struct.pack("<H", 8) + _NOTE + struct.pack("<HI", 4, size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _clean(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def page_record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, revisit: bool) -> bytes:
    """One page as a response or revisit record."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{PAGE_URN}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, payload_digest(payload) + _clean(url))}>"),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Date", EPOCH),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("X-Payload-Bytes", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{PAGE_URN}{keeper}>")]
    return _record(headers, head if revisit else head + payload)


@dataclass
class ArchiveFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str


class _Input:
    """A forward reader with a buffer over a file."""

    def __init__(self, file):
        self.file, self.data, self.at = file, b"", 0

    def need(self, size: int) -> bool:
        """Have ``size`` bytes at hand, if the file has them."""
        while len(self.data) - self.at < size:
            more = self.file.read(max(_CHUNK, size - len(self.data) + self.at))
            if not more:
                return False
            self.data, self.at = self.data[self.at :] + more, 0
        return True

    def take(self, size: int) -> bytes:
        self.need(size)
        out = self.data[self.at : self.at + size]
        self.at += len(out)
        return out

    def skip(self, size: int) -> None:
        held = len(self.data) - self.at
        if size <= held:
            self.at += size
        else:
            self.file.seek(size - held, 1)
            self.data, self.at = b"", 0

    def rest(self) -> bytes:
        self.need(1)
        return self.data[self.at :]


def _headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if value:
            out.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return out


def _noted_member(source: _Input) -> int | None:
    """Length of the gzip member at hand, if its header says so."""
    if not source.need(_FIXED) or source.data[source.at + 3] != 4:
        return None
    extra = source.data[source.at + 10 : source.at + _FIXED]
    return struct.unpack("<I", extra[6:10])[0] if extra[2:4] == _NOTE else None


class _Inflated:
    """A file of gzip members as one stream of bytes, for archives without notes."""

    def __init__(self, source: _Input):
        self.source, self.packer = source, None

    def read(self, size: int) -> bytes:
        out = b""
        while not out and (self.source.need(1)):
            self.packer = self.packer or zlib.decompressobj(31)
            data = self.source.rest()
            self.source.at = len(self.source.data)
            out = self.packer.decompress(data)
            if self.packer.eof:
                unused, self.packer = self.packer.unused_data, None
                self.source.data, self.source.at = unused, 0
        return out

    def seek(self, size: int, whence: int) -> None:
        while size > 0 and (data := self.read(size)):
            if len(data) > size:
                raise OSError("seek past buffered data")
            size -= len(data)


def records(file, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block of each record that ``wanted`` accepts by its headers;
    the block is None, and stays packed, unless ``with_payload``."""
    source = _Input(file)
    while source.need(1):
        packed = not isinstance(source, _Streamed) and source.need(2) and source.data[source.at : source.at + 2] == b"\x1f\x8b"
        size = _noted_member(source) if packed else None
        if packed and size is None:
            source = _Streamed(_Inflated(source))
            continue
        if size is not None:
            if not source.need(min(size, 4096 + _FIXED)):
                source.need(size)
            packer, data = zlib.decompressobj(-15), b""
            start, have = source.at + _FIXED, min(size, len(source.data) - source.at)
            data = packer.decompress(source.data[start : source.at + min(have, 4096 + _FIXED)], 8192)
            if b"\r\n\r\n" not in data:  # unusually long headers
                source.need(size)
                packer, data = zlib.decompressobj(-15), b""
                data = packer.decompress(source.data[source.at + _FIXED : source.at + size - 8])
            head, _, _ = data.partition(b"\r\n\r\n")
            headers = _headers(head)
            if not wanted(headers):
                source.skip(size)
                continue
            block = None
            if with_payload:
                member = source.take(size)
                whole = zlib.decompress(member[_FIXED:-8], -15)
                if len(member) != size or zlib.crc32(whole) != struct.unpack("<I", member[-8:-4])[0]:
                    raise OSError("damaged WARC member")
                block = whole[len(head) + 4 : len(head) + 4 + int(headers["content-length"])]
            else:
                source.skip(size)
            yield headers, block
            continue
        reach = 4096
        while (end := source.data.find(b"\r\n\r\n", source.at)) < 0 and source.need(reach):
            reach *= 2
        if end < 0 and (end := source.data.find(b"\r\n\r\n", source.at)) < 0:
            if source.data[source.at :].strip():
                raise OSError("damaged WARC record")
            return
        headers = _headers(source.data[source.at : end].lstrip())
        source.at = end + 4
        length = int(headers.get("content-length", 0))
        keep = wanted(headers)
        block = source.take(length) if keep and with_payload else source.skip(length)
        source.take(4)
        if keep:
            yield headers, block


class _Streamed(_Input):
    """An input that can only go forward by reading."""

    def skip(self, size: int) -> None:
        while size > 0 and self.need(1):
            step = min(size, len(self.data) - self.at)
            self.at, size = self.at + step, size - step


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.path, self.verify = options.get("path"), str(options.get("verify", "false")).lower() == "true"
        self.tests: list[tuple[str, frozenset]] = []
        unknown = set(self.names) - {*HEADER_OF, "payload"}
        if unknown:
            raise ValueError(f"no such WARC column: {sorted(unknown)}")

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            text = column in HEADER_OF and column not in ("payload_bytes", "content_length")
            if text and isinstance(f, EqualTo):
                self.tests.append((column, frozenset([f.value])))
            elif text and isinstance(f, In):
                self.tests.append((column, frozenset(f.value)))
            elif text and isinstance(f, IsNotNull):
                self.tests.append((column, frozenset()))
            else:
                yield f

    def partitions(self):
        files, path = _filesystem(self.path)
        info = files.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(path, recursive=True))
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        return [ArchiveFile(prefix + f.path) for f in sorted(found, key=lambda x: x.path) if f.type == pafs.FileType.File and f.base_name.endswith((".warc", ".warc.gz"))]

    @staticmethod
    def _value(name: str, headers: dict[str, str]):
        value = headers.get(HEADER_OF[name])
        if value is None:
            return None
        if name in ("payload_bytes", "content_length"):
            return int(value)
        if name in ("record_id", "refers_to"):
            return value.strip("<>")
        return value.partition(":")[2] if name == "payload_digest" and ":" in value else value

    def _wanted(self, headers: dict[str, str]) -> bool:
        return all((value := self._value(name, headers)) is not None and (not allowed or value in allowed) for name, allowed in self.tests)

    def read(self, partition: ArchiveFile | None) -> Iterator[tuple]:
        if partition is None:  # what Spark plans for a folder without archives
            return
        files, path = _filesystem(partition.path)
        with files.open_input_file(path) as file:
            for headers, block in records(file, self._wanted, self.verify or "payload" in self.names):
                payload = None
                if block is not None:
                    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                    if headers.get("warc-type") == "revisit":
                        payload = None
                    elif self.verify and (size := self._value("payload_bytes", headers)) is not None and size != len(payload):
                        raise OSError(f"payload length differs in {partition.path}: {headers.get('warc-record-id')}")
                    elif self.verify and (digest := self._value("payload_digest", headers)) and digest != payload_digest(payload):
                        raise OSError(f"payload digest differs in {partition.path}: {headers.get('warc-record-id')}")
                yield tuple(payload if n == "payload" else self._value(n, headers) for n in self.names)


class WarcPageWriter(DataSourceArrowWriter):
    """Writes rows of page_id, url, payload, keeper, revisit; files appear on commit."""

    def __init__(self, options):
        self.path, self.level = options["path"], int(options.get("level", 4))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage | None:
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return Written("")
        files, folder = _filesystem(self.path)
        files.create_dir(folder, recursive=True)
        name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        with files.open_output_stream(f"{name}.open") as out:
            out.write(_member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", EPOCH), ("Content-Type", "application/warc-fields")], b"software: webweft\r\nformat: WARC File Format 1.1\r\n"), self.level))
            for batch in _with_first(first, iterator):
                for page in batch.to_pylist():
                    out.write(_member(page_record(page["page_id"], page["url"], page["payload"], page["keeper"], page["revisit"]), self.level))
        return Written(name)

    def commit(self, messages) -> None:
        files, folder = _filesystem(self.path)
        files.create_dir(folder, recursive=True)
        for m in messages:
            if m and m.path:
                files.move(f"{m.path}.open", m.path)

    def abort(self, messages) -> None:
        files, _ = _filesystem(self.path)
        for m in messages:
            if m and m.path:
                files.delete_file(f"{m.path}.open")


def _with_first(first, rest):
    yield first
    yield from rest


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> WarcPageWriter:
        return WarcPageWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, path: str, min_revisit_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archive each row of ``pages`` under ``path`` with its html as payload.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, those
    with the smallest page id are responses and the others revisit it. Null html
    is an empty payload, a null url an empty one. Rows with a null page id are
    responses, and nothing revisits them. Rows that repeat a page id and payload
    are alike: all responses or all revisits. Payloads of any length are written whole,
    each in memory once. An empty table writes no file. Page ids are whole numbers. Other
    columns are ignored, whatever their names.
    """
    register(pages.sparkSession)
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    marked = rows.select("page_id", F.sha1("payload").alias("_sha"), F.length("payload").alias("_n")).where(F.col("page_id").isNotNull() & (F.col("_n") >= min_revisit_bytes))
    keepers = marked.groupBy("_sha", "_n").agg(F.min("page_id").alias("keeper"), F.max("page_id").alias("_last")).where("_last > keeper").drop("_last")
    # Only pages that revisit another are looked up, by id and digest, not the payloads by their groups.
    revisits = materialize(marked.distinct().join(keepers, ["_sha", "_n"]).where("page_id > keeper").select(F.col("page_id").alias("_id"), "_sha", "keeper"), "warc-revisits")
    if revisits.count() <= BROADCAST_REVISITS:  # a number, a digest and a number each
        revisits = F.broadcast(revisits)
    # Rows without an id are in no join, where they would meet in one task.
    named = rows.where("page_id is not null").withColumn("_sha1", F.sha1("payload"))
    done = named.join(revisits, (F.col("page_id") == F.col("_id")) & (F.col("_sha1") == F.col("_sha")), "left").select(*rows.columns, "keeper")
    done = done.unionByName(rows.where("page_id is null").withColumn("keeper", F.lit(None).cast("long")))
    done.select("page_id", "url", "payload", "keeper", F.col("keeper").isNotNull().alias("revisit")).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The archives' pages, from their headers: page_id, payload_bytes,
    payload_digest, record_type, refers_to. With ``verify``, every response's
    payload is inflated and checked against its digest on the way."""
    register(spark)
    schema = "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long"
    found = spark.read.format("warc").schema(schema).option("verify", str(verify).lower()).load(path).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.when(F.col(c).startswith(PAGE_URN), F.substring_index(c, ":", -1).cast("long"))
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_pages(pages, path, min_revisit_bytes)
    return read_pages(spark, path)
