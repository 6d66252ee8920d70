"""WARC 1.1 archives as a Python data source of Spark: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading. Files are dealt into partitions of about ``split_bytes``, from the folder's manifest or else its listing.
Equality and IN predicates on record_type and the header columns are pushed down: headers are parsed first, and the
block of a record that fails them is skipped by its Content-Length, or in a gzip file by the member length that the
writer leaves in the ``sl`` extra field, so it is neither read nor decoded. Option ``payload``: ``yes`` (default),
``no`` (null; blocks are skipped) or ``verify`` (null, but each payload is held against its digest).

Writing. A task writes files under names of its own and reports them; the manifest, written at commit, lists what
counts. A task that is run again leaves files that no manifest names, so readers see each record once.

A record has its page's payload behind an HTTP head. ``write_pages`` makes records of equal payloads revisits of the
one with the smallest page_id; a revisit keeps the head, so the payload's length stays known.

Defined results. Null html: an empty payload. Null url: no target header. Null page_id: never the smallest; a revisit
if an equal payload has an id, else a response. Repeated rows of a group's smallest page_id are all responses. Empty
table: an archive without records. Other columns of the input, whatever their names, are not read. One very long page
is held by one worker.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from . import common

MANIFEST = "_manifest.json"
_COLUMNS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
_SCHEMA = pa.schema([*((c, pa.string()) for c in _COLUMNS), ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])
_DDL = ", ".join([*(f"{c} string" for c in _COLUMNS), "headers map<string,string>, payload_bytes long, payload binary, path string, offset long"])
_HTTP = "application/http; msgtype=response"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records as bytes ---------------------------------------------------------------------------------------------


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """``data`` as one gzip member whose extra field ``sl`` has the member's length and the data's."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _field(headers: dict[str, str], name: str) -> str | None:
    if name in headers:
        return headers[name]
    low = name.lower()
    return next((v for k, v in headers.items() if k.lower() == low), None)


class _Plain:
    """Records of an uncompressed file."""

    def __init__(self, file):
        self.file, self.buffer, self.at = file, b"", 0  # buffer begins at place ``at`` of the file

    def _fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            more = self.file.read(max(1 << 16, n - len(self.buffer)))
            if not more:
                return False
            self.buffer += more
        return True

    def head(self) -> bytes | None:
        while True:
            end = self.buffer.find(b"\r\n\r\n")
            if end > 0:
                head, self.buffer = self.buffer[:end], self.buffer[end + 4 :]
                self.start, self.at = self.at, self.at + end + 4
                return head
            if not self._fill(len(self.buffer) + 1):
                return None

    def block(self, n: int) -> bytes:
        self._fill(n + 4)
        block, self.buffer = self.buffer[:n], self.buffer[n + 4 :]
        self.at += n + 4
        return block

    def skip(self, n: int) -> None:
        n += 4
        self.at += n
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.file.seek(n - len(self.buffer), 1)
            self.buffer = b""


class _Gzip:
    """Records of a file with a gzip member each."""

    def __init__(self, file):
        self.file, self.buffer, self.at = file, b"", 0

    def head(self) -> bytes | None:
        if len(self.buffer) < 64:
            self.buffer += self.file.read(1 << 16)
        if not self.buffer:
            return None
        self.start, self.length = self.at, None
        if self.buffer[3] & 4 and self.buffer[12:14] == b"sl":
            self.length = struct.unpack_from("<I", self.buffer, 16)[0]
        self.inflate, self.text, self.fed = zlib.decompressobj(31), b"", 0
        while (end := self.text.find(b"\r\n\r\n")) < 0:
            if not self._more(4096):
                return None
        head, self.text = self.text[:end], self.text[end + 4 :]
        return head

    def _more(self, n: int) -> bool:
        """Inflate the next ``n`` compressed bytes of this member."""
        if self.inflate.eof:
            return False
        if self.fed >= len(self.buffer):
            more = self.file.read(1 << 18)
            if not more:
                return False
            self.buffer += more
        part = self.buffer[self.fed : self.fed + n]
        self.text += self.inflate.decompress(part)
        self.fed += len(part) - len(self.inflate.unused_data)
        return True

    def _drop(self, n: int) -> None:
        self.at += n
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.file.seek(n - len(self.buffer), 1)
            self.buffer = b""

    def block(self, n: int) -> bytes:
        parts = [self.text]
        while not self.inflate.eof:
            self.text = b""
            if not self._more(1 << 18):
                break
            parts.append(self.text)
        self._drop(self.fed)
        return b"".join(parts)[:n]

    def skip(self, n: int) -> None:
        if self.length:
            self._drop(self.length)
        else:
            self.block(n)


# --- reading ------------------------------------------------------------------------------------------------------


@dataclass
class _Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "yes")
        self.split = int(options.get("split_bytes", 64 << 20))
        self.wanted: dict[str, set[str]] = {}
        if self.payload not in ("yes", "no", "verify"):
            raise ValueError("payload must be yes, no or verify")

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in _COLUMNS and None not in values:
                known = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if known is None else known & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            files = [(root, info.size)]
        elif fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                files = [(f"{root}/{x['name']}", x["bytes"]) for x in json.loads(f.read())["files"]]
        else:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            files = [(x.path, x.size) for x in found if x.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path)]
        parts, names, total = [], [], 0
        for name, size in sorted(files):
            if names and total + size > self.split:
                parts.append(_Files(names))
                names, total = [], 0
            names.append(name)
            total += size
        return [*parts, _Files(names)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for name in partition.names:
            with fs.open_input_file(name) as file:
                records = (_Gzip if name.endswith(".gz") else _Plain)(file)
                while (head := records.head()) is not None:
                    row = self._record(records, parse_headers(head), name)
                    if row:
                        rows.append(row)
                        held += len(row["payload"] or b"") + 1000
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    def _record(self, records, headers: dict[str, str], name: str) -> dict | None:
        n = int(_field(headers, "Content-Length") or 0)
        row = {c: _field(headers, h) for c, h in _COLUMNS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if any(row[c] not in values for c, values in self.wanted.items()):
            records.skip(n)
            return None
        row |= {"headers": list(headers.items()), "path": name, "offset": records.start, "payload": None, "payload_bytes": None}
        http = (row["content_type"] or "").startswith("application/http")
        if self.payload == "no" and not http:
            records.skip(n)
            row["payload_bytes"] = n
            return row
        if self.payload == "no" and "X-Payload-Length" in headers:
            records.skip(n)
            row["payload_bytes"] = int(headers["X-Payload-Length"])
            return row
        block = records.block(n)
        if len(block) < n:
            raise ValueError(f"{name} ends within the record at {records.start}")
        if not http:
            row["payload_bytes"] = n
            payload = block
        else:
            head, _, payload = block.partition(b"\r\n\r\n")
            length = _field(parse_headers(head), "Content-Length")
            row["payload_bytes"] = int(length) if length is not None else len(payload)
        if row["record_type"] == "revisit":
            return row
        if self.payload == "verify" and row["payload_digest"] and payload_digest(payload) != row["payload_digest"]:
            raise ValueError(f"{name}: the payload of the record at {records.start} doesn't have its digest")
        if self.payload == "yes":
            row["payload"] = payload
        return row


# --- writing ------------------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    """Takes the columns of _COLUMNS (all but content_type), payload_bytes and payload; a null payload makes a record of its head alone."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.roll = int(options.get("file_bytes", 128 << 20))
        self.overwrite = overwrite

    def _record(self, row: dict) -> bytes:
        headers = {"WARC-Type": row["record_type"] or "resource", "WARC-Record-ID": f"<{row['record_id'] or uuid.uuid4().urn}>", "WARC-Date": row["date"] or "1970-01-01T00:00:00Z"}
        if row["target_uri"] is not None:
            headers["WARC-Target-URI"] = row["target_uri"]
        payload = row["payload"] or b""
        n = len(payload) if row["payload_bytes"] is None else row["payload_bytes"]
        headers["WARC-Payload-Digest"] = f"sha1:{row['payload_digest'] or payload_digest(payload)}"
        if row["record_type"] == "revisit":
            headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{row['refers_to']}>"}
        headers |= {"X-Payload-Length": str(n), "Content-Type": _HTTP}
        data = record_bytes(headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n + payload)
        return gzip_member(data) if self.gzip else data

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files: list[dict] = []
        out = None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        files.append({"name": f"part-{common.partition_index():05d}-{uuid.uuid4().hex}.warc{'.gz' * self.gzip}", "records": 0, "bytes": 0})
                        out = fs.open_output_stream(f"{root}/{files[-1]['name']}", compression=None)
                    data = self._record(row)
                    out.write(data)
                    files[-1]["records"] += 1
                    files[-1]["bytes"] += len(data)
                    if files[-1]["bytes"] >= self.roll:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        old = f"{root}/{MANIFEST}"
        if not self.overwrite and fs.get_file_info(old).type == pafs.FileType.File:
            with fs.open_input_stream(old) as f:
                files = json.loads(f.read())["files"] + files
        with fs.open_output_stream(f"{old}.new") as f:
            f.write(json.dumps({"files": files}).encode())
        fs.move(f"{old}.new", old)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{root}/{f['name']}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to ``spark``, with predicates pushed down."""
    common.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: str = "yes") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def page_records(pages: DataFrame) -> DataFrame:
    """Records of ``pages`` (page_id, url, html), as the writer takes them.

    Digests are grouped first, after each task has combined its own; only groups of two or more come back, and
    pages join those, so payloads shuffle only if so many groups repeat that they can't be broadcast.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("target_uri"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha1"))
    groups = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n >= 2").select(F.col("sha1").alias("group_sha1"), "first")
    groups = common.stage(groups, "warc-groups")
    side = common.bounded_broadcast(groups, groups.count(), 64)
    urn = lambda c: F.concat(F.lit("urn:x-page:"), c.cast("string"))
    found = rows.join(side, F.col("sha1") == F.col("group_sha1"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"), "target_uri", F.lit(None).cast("string").alias("date"), F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(~again, F.col("payload")).alias("payload"), "sha1",
    )


def _base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = pa.array([base64.b32encode(x).decode() for x in batch.column("sha1").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], digests], names=[*batch.schema.names[:-1], "payload_digest"])


def write_pages(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    spark = pages.sparkSession
    register(spark)
    rows = page_records(pages)
    ddl = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_bytes long, payload binary, payload_digest string"
    rows.mapInArrow(_base32, ddl).write.format("warc").mode("append").option("compression", compression).save(path)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "warc")
    write_pages(common.table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path, "verify").where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^urn:x-page:(-?[0-9]+)$', 1), '') as bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
