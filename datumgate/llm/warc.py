"""WARC archives as a Python data source, and page archives with revisit records.

Files hold one gzip member per record, each with the ``sl`` (skip lengths) field
of the format's gzip annex, so a reader inflates only the header of a record it
does not want and jumps over the rest. Members without that field are inflated
and dropped. Plain files are read as well. Partitions are whole files, packed by
size; the writer starts a new file at ``roll_bytes``. Predicates on the record type
and on header columns are options of the reader, which tests them on the header alone;
``payload=false`` leaves the payload out of the schema and never decodes it. They are options because
Spark 4.1.2 keeps filters that it pushes into a Python data source for later queries of the same
DataFrame, which then miss rows.

A task writes hidden files; the commit on the driver renames those of the
successful attempts, so a lost executor leaves no visible part.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

# Names and marks of the WARC and gzip formats.
VERSION = b"WARC/1.1"
EXTENSIONS = (".warc", ".warc.gz")
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_COLUMNS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
IN_BRACKETS = ("record_id", "refers_to")
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long"
ROLL_BYTES = 64 << 20
PARTITION_BYTES = 64 << 20
EPOCH = "1970-01-01T00:00:00Z"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


# Records


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row) -> bytes:
    """A whole record: header, HTTP header, payload (responses only)."""
    payload = bytes(row["payload"] or b"")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (row["payload_bytes"] or 0)
    block = http + (payload if row["record_type"] != REVISIT else b"")
    lines = [VERSION.decode()]
    for column, name in HEADER_COLUMNS.items():
        if row[column] is not None:
            value = _clean(row[column])
            lines.append(f"{name}: <{value}>" if column in IN_BRACKETS else f"{name}: {value}")
    if row["record_type"] == REVISIT:
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + len(tail)
    extra = b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


class _Plain:
    """A record of an uncompressed file."""

    def __init__(self, source):
        self.source, self.start = source, source.tell()

    def head(self, size: int) -> bytes:
        self.source.seek(self.start)
        return self.source.read(size)

    def whole(self, size: int) -> bytes:
        return self.head(size)

    def skip(self, size: int) -> None:
        self.source.seek(self.start + size)


class _Member:
    """A record in a gzip member of its own."""

    def __init__(self, source):
        self.source, self.start = source, source.tell()
        fixed = source.read(12)
        if fixed[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        self.size, flags = None, fixed[3]
        if flags & 4:
            (length,) = struct.unpack("<H", fixed[10:12])
            extra = source.read(length)
            if extra[:2] == b"sl" and length >= 12:
                (self.size,) = struct.unpack("<I", extra[4:8])

    def _inflate(self, limit: int) -> tuple[bytes, int | None]:
        """Up to ``limit`` bytes, and the member's length if its end was met."""
        self.source.seek(self.start)
        unpacker, out, used = zlib.decompressobj(31), [], 0
        have = 0
        while have < limit and not unpacker.eof:
            raw = unpacker.unconsumed_tail or self.source.read(1 << 16 if limit > 1 << 16 else 4096)
            if not raw:
                raise ValueError("cut gzip member")
            used += 0 if unpacker.unconsumed_tail else len(raw)
            got = unpacker.decompress(raw, limit - have)
            out.append(got)
            have += len(got)
        return b"".join(out), used - len(unpacker.unused_data) if unpacker.eof else None

    def head(self, size: int) -> bytes:
        return self._inflate(size)[0]

    def whole(self, size: int) -> bytes:
        return self._inflate(size)[0]

    def skip(self, size: int) -> None:
        if self.size is None:
            self.size = self._inflate(1 << 62)[1]
        self.source.seek(self.start + self.size)


def _header(record) -> tuple[dict[str, str], int]:
    size = 2048
    while True:
        head = record.head(size)
        end = head.find(b"\r\n\r\n")
        if end >= 0:
            break
        if len(head) < size:
            raise ValueError("record without a header")
        size *= 4
    lines = head[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    for column in IN_BRACKETS:
        name = HEADER_COLUMNS[column].lower()
        if name in fields:
            fields[name] = fields[name].removeprefix("<").removesuffix(">")
    return fields, end + 4


def read_records(source, size: int, wanted, with_payload: bool) -> Iterator[tuple]:
    """Rows of one open file; the block of a record that is not ``wanted`` is skipped."""
    source.seek(0)
    packed = source.read(2) == b"\x1f\x8b"
    at = 0
    while at < size:
        source.seek(at)
        record = _Member(source) if packed else _Plain(source)
        fields, start = _header(record)
        length = int(fields["content-length"])
        row = [fields.get(name.lower()) for name in HEADER_COLUMNS.values()]
        if wanted(dict(zip(HEADER_COLUMNS, row, strict=True))):
            http_size = 4096
            whole = length if with_payload and row[0] != REVISIT else min(length, http_size)
            block = record.whole(start + whole)[start:]
            cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
            stated = [x for x in block[:cut].lower().split(b"\r\n") if x.startswith(b"content-length:")]
            row.append(int(stated[0].partition(b":")[2]) if stated else length - cut)
            if with_payload:
                row.append(None if row[0] == REVISIT else block[cut:length])
            yield tuple(row)
        record.skip(start + length + 4)
        at = source.tell()


# Data source


@dataclass
class _Files(InputPartition):
    paths: list[tuple[str, int]]

    def __init__(self, paths):
        super().__init__(None)
        self.paths = paths


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters = [(name, "in", set(values)) for name, values in json.loads(options.get("among", "{}")).items()]
        self.filters += [(name, "starts", lead) for name, lead in json.loads(options.get("starting", "{}")).items()]
        unknown = {name for name, _, _ in self.filters} - set(HEADER_COLUMNS)
        if unknown:
            raise ValueError(f"not columns of the record header: {sorted(unknown)}")

    def _wanted(self, row) -> bool:
        for name, how, value in self.filters:
            have = row[name]
            if have is None or (how == "in" and have not in value) or (how == "starts" and not have.startswith(value)):
                return False
        return True

    def partitions(self):
        fs, root = _file_system(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted(
            (f.size, f.path)
            for f in found
            if f.is_file and f.size and not f.base_name.startswith((".", "_")) and f.path.endswith(EXTENSIONS)
        )
        packs: list[list[tuple[str, int]]] = []
        filled = 0
        for size, path in files:
            if not packs or filled + size > self.partition_bytes:
                packs.append([])
                filled = 0
            packs[-1].append((path, size))
            filled += size
        return [_Files(p) for p in packs] or [_Files([])]

    def read(self, partition):
        fs, _ = _file_system(self.path)
        for path, size in partition.paths:
            with fs.open_input_file(path) as source:
                yield from read_records(source, size, self._wanted, self.with_payload)


class WarcWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.roll_bytes = int(options.get("roll_bytes", ROLL_BYTES))

    def write(self, rows):
        fs, root = _file_system(self.path)
        names, sink, filled = [], None, 0
        try:
            for row in rows:
                if sink is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    fs.create_dir(root, recursive=True)
                    sink, filled = fs.open_output_stream(f"{root}/.{names[-1]}", compression=None), 0
                member = gzip_member(record_bytes(row))
                sink.write(member)
                filled += len(member)
                if filled >= self.roll_bytes:
                    sink.close()
                    sink = None
        finally:
            if sink is not None:
                sink.close()
        return _Written(names)

    def commit(self, messages):
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                fs.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages):
        fs, root = _file_system(self.path)
        for message in messages:
            for name in message.names if message else ():
                fs.delete_file(f"{root}/.{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA + ("" if self.options.get("payload", "true").lower() == "false" else ", payload binary")

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


# Page archives

PAGE = "urn:x-page:"


def page_uri(column):
    """An identifier of any type as a URI, escaped so that it stays on its header line; a null one has no colon behind it."""
    return F.coalesce(F.concat(F.lit(PAGE), F.url_encode(column.cast("string"))), F.lit(PAGE[:-1]))


def page_records(
    pages: DataFrame, min_revisit_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Rows to write: the first page (smallest id) with a payload is the response, later ones revisit it.

    Defined results: a null html is an empty payload; rows that share the
    smallest id and the payload are all responses; null ids sort last, and where
    all ids of a payload are null, all are responses; payloads of
    less than ``min_revisit_bytes`` bytes are always responses.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    hashed = base.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    firsts = (
        hashed.where(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first_id")
    )
    joined = hashed.join(firsts, "digest", "left")
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        F.when(revisits, REVISIT).otherwise(RESPONSE).alias("record_type"),
        page_uri(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(EPOCH).alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(revisits, page_uri(F.col("first_id"))).alias("refers_to"),
        "payload_bytes",
        F.when(~revisits, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").option("path", path).save()


def read_warc(
    spark: SparkSession,
    path: str,
    payload: bool = True,
    *,
    among: dict[str, list[str]] | None = None,
    starting: dict[str, str] | None = None,
) -> DataFrame:
    """Records of the archives below ``path``.

    ``among`` (column: values it may have) and ``starting`` (column: how it begins) are predicates on header columns.
    Records they refuse, and those where such a column is null, are skipped by their header: the payload is not inflated.
    """
    register(spark)
    reader = spark.read.format("warc").option("path", path).option("payload", str(payload).lower())
    return reader.option("among", json.dumps(among or {})).option("starting", json.dumps(starting or {})).load()


def page_of(uri, id_type: str = "long"):
    named = F.when(F.startswith(uri, F.lit(PAGE)), F.substr(uri, F.lit(len(PAGE) + 1)))
    return F.try_url_decode(named).try_cast(id_type)


def archived_pages(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """What the archives hold of each page; digests of responses are computed from the payload read.

    ``id_type`` is the type of the page identifiers that were written; other records' identifiers are null.
    """
    responses = read_warc(spark, path, among={"record_type": [RESPONSE]})
    revisits = read_warc(spark, path, payload=False, among={"record_type": [REVISIT]})
    columns = lambda size, digest: [
        page_of(F.col("record_id"), id_type).alias("page_id"),
        size.cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to"), id_type).alias("refers_to"),
    ]
    return responses.select(*columns(F.octet_length("payload"), F.sha2("payload", 256))).unionByName(
        revisits.select(*columns(F.col("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "")))
    )

