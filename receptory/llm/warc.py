"""WARC archives as a PySpark Python data source, read and written.

Written archives are files of gzip members, one a record, each with a sidecar
of the members' offsets; a manifest names the files of the tasks that
committed, so files of lost attempts are never read.  The reader plans one
partition a file, and splits larger files between records by the sidecar.
Predicates on the record type and the header columns are pushed into it.  It
inflates a record only until its headers end, tests the predicates, and
inflates the payload only if the record is wanted and the payload is among the
columns asked for; otherwise it goes on at the next member's offset.  Archives
of others, without sidecars, plain or compressed, are read in sequence.

Paths may be local (file:) or of any store that pyarrow's file systems open.

Edge cases: a null page_id, url or html is written as no id, no target and an
empty payload; line breaks in header values are percent-encoded; repeated rows
are records each; of several rows with the largest page_id and equal payloads
all are responses; an empty table makes an archive without records.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from receptory.llm.common import shared_dir, table

SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Header of each column that predicates can be pushed to.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4 << 20


class Store:
    """Files below one path, local or remote."""

    def __init__(self, path: str):
        if path.startswith("file:") or "://" not in path:
            from pyarrow import fs

            self.fs, self.root = fs.LocalFileSystem(), os.path.abspath("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(path)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def sizes(self) -> dict[str, int]:
        from pyarrow import fs

        info = self.fs.get_file_info(self.root)
        if info.type == fs.FileType.File:
            return {"": info.size}
        found = self.fs.get_file_info(fs.FileSelector(self.root, recursive=True))
        return {x.path[len(self.root) :].lstrip("/"): x.size for x in found if x.type == fs.FileType.File}

    def read(self, name: str) -> bytes:
        with self.fs.open_input_file(self.at(name)) as f:
            return f.read()


@dataclass
class Span(InputPartition):
    """Records first..last of a file; last -1: the whole file, in sequence."""

    name: str
    first: int = 0
    last: int = -1

    def __post_init__(self) -> None:
        super().__init__(None)


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


def parse_headers(block: bytes) -> dict[str, str]:
    """Header names in lower case, with their values."""
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, found, value = line.partition(b":")
        if found:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _bare(name: str, value: str | None) -> str | None:
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.partition(":")[2] if name == "payload_digest" and ":" in value else value


def wanted(headers: dict[str, str], tests: list[tuple]) -> bool:
    """All pushed predicates hold for these headers."""
    for kind, column, value in tests:
        own = _bare(column, headers.get(HEADERS[column]))
        if own is None or kind == "in" and own not in value or kind == "prefix" and not own.startswith(value):
            return False
    return True


class Member:
    """One record of a stream: inflated, or read, no further than asked for."""

    def __init__(self, data: io.BufferedIOBase, packed: bool):
        self.data, self.inflate = data, zlib.decompressobj(31) if packed else None
        self.held = b""

    def more(self, n: int = 4096) -> bool:
        raw = self.data.read(n)
        if not raw:
            return False
        self.held += self.inflate.decompress(raw) if self.inflate else raw
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        head, self.held = self.held[:at], self.held[at + len(mark) :]
        return head

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n and (raw := self.data.read(max(4096, n - have if not self.inflate else 65536))):
            parts.append(self.inflate.decompress(raw) if self.inflate else raw)
            have += len(parts[-1])
        whole = b"".join(parts)
        out, self.held = whole[:n], whole[n:]
        return out


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema.names, options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple] = []
        unknown = set(self.columns) - {*HEADERS, "payload_length", "payload"}
        if unknown:
            raise ValueError(f"a WARC record has no columns {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            column = one.attribute[0] if hasattr(one, "attribute") and len(one.attribute) == 1 else None
            if column not in HEADERS:
                yield one
            elif isinstance(one, EqualTo):
                self.tests.append(("in", column, (one.value,)))
            elif isinstance(one, In):
                self.tests.append(("in", column, tuple(one.value)))
            elif isinstance(one, StringStartsWith):
                self.tests.append(("prefix", column, one.value))
            else:
                yield one

    def partitions(self) -> list[InputPartition]:
        store = Store(self.path)
        sizes = store.sizes()
        names = json.loads(store.read("_manifest.json")) if "_manifest.json" in sizes else sorted(x for x in sizes if x == "" or x.endswith((".warc", ".warc.gz")))
        out: list[InputPartition] = []
        for name in names:
            if name + ".idx" not in sizes:
                out.append(Span(name))
                continue
            if sizes[name] <= self.partition_bytes:
                out.append(Span(name, 0, sizes[name + ".idx"] // 8 - 1))
                continue
            starts = np.frombuffer(store.read(name + ".idx"), "<i8")
            cuts = np.unique(np.searchsorted(starts, np.arange(0, sizes[name], self.partition_bytes)))
            out += [Span(name, int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(starts) - 1], strict=True) if a < b]
        return out or [Span("", 0, 0)]

    def records(self, span: Span) -> Iterator[tuple]:
        if span.first == span.last:
            return
        store = Store(self.path)
        with store.fs.open_input_file(store.at(span.name)) as file:
            if span.last >= 0:
                starts = np.frombuffer(store.read(span.name + ".idx"), "<i8")[span.first : span.last + 1]
                for at, after in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    file.seek(at)
                    yield from self.one(Member(io.BufferedReader(_Window(file, after - at), 8192), True), False)
                return
            start = file.read(2)
            file.seek(0)
            data = gzip.GzipFile(fileobj=file) if start == b"\x1f\x8b" else file
            member = Member(data, False)
            while True:
                before = member.held
                if not before.strip() and not member.more(1 << 16) and not member.held.strip():
                    return
                member.held = member.held.lstrip(b"\r\n")
                yield from self.one(member, True)

    def one(self, member: Member, in_sequence: bool) -> Iterator[tuple]:
        head = member.until(b"\r\n\r\n")
        if head is None:
            member.held = b""
            return
        headers = parse_headers(head)
        size = int(headers.get("content-length", 0))
        if not wanted(headers, self.tests):
            if in_sequence:
                self.skip(member, size + 4)
            return
        length, payload = size, None
        needs = "payload" in self.columns or "payload_length" in self.columns
        left = size
        if needs and headers.get("content-type", "").startswith("application/http"):
            http = member.until(b"\r\n\r\n") or b""
            left = max(0, size - len(http) - 4)
            length = int(parse_headers(http).get("content-length", left))
        if "payload" in self.columns:
            payload = member.take(left)
            left = 0
        if in_sequence:
            self.skip(member, left + 4)
        row = {x: _bare(x, headers.get(h)) for x, h in HEADERS.items()} | {"payload_length": length, "payload": payload}
        yield tuple(row[x] for x in self.columns)

    def skip(self, member: Member, n: int) -> None:
        while n > 0:
            taken = member.take(min(n, 1 << 20))
            if not taken:
                return
            n -= len(taken)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        at = self.columns.index("payload") if "payload" in self.columns else None
        kinds = [pa.binary() if x == "payload" else pa.int64() if x == "payload_length" else pa.string() for x in self.columns]

        def flush() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, self.columns)

        for row in self.records(partition):
            rows.append(row)
            size += 200 + (len(row[at] or b"") if at is not None else 0)
            if size >= BATCH_BYTES:
                yield flush()
                size = 0
        if rows:
            yield flush()


class _Window(io.RawIOBase):
    """The next n bytes of a file."""

    def __init__(self, file, n: int):
        self.file, self.left = file, n

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        raw = self.file.read(min(len(buffer), self.left))
        buffer[: len(raw)] = raw
        self.left -= len(raw)
        return len(raw)


def record(row: dict) -> bytes:
    """One WARC record; a revisit keeps the full payload's length in its HTTP headers and no payload."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["warc_date"])]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    head = "".join(f"{k}: {v.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n" for k, v in fields if v is not None)
    return b"".join((b"WARC/1.1\r\n", head.encode(), b"\r\n", http, payload, b"\r\n\r\n"))


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", 4))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store = Store(self.path)
        store.fs.create_dir(store.root, recursive=True)
        name = f"records-{uuid.uuid4().hex}.warc.gz"
        starts, at = [0], 0
        with store.fs.open_output_stream(store.at(name), compression=None) as out:
            for batch in iterator:
                columns = batch.schema.names
                for i in range(0, batch.num_rows, 64):
                    for values in zip(*(x.to_pylist() for x in batch.slice(i, 64).columns), strict=True):
                        pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                        raw = pack.compress(record(dict(zip(columns, values, strict=True)))) + pack.flush()
                        out.write(raw)
                        at += len(raw)
                        starts.append(at)
        with store.fs.open_output_stream(store.at(name + ".idx")) as out:
            out.write(np.array(starts, "<i8").tobytes())
        return Written(name, len(starts) - 1)

    def commit(self, messages: list[Written | None]) -> None:
        store = Store(self.path)
        store.fs.create_dir(store.root, recursive=True)
        with store.fs.open_output_stream(store.at("_manifest.json")) as out:
            out.write(json.dumps(sorted(x.name for x in messages if x and x.records)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store = Store(self.path)
        for x in messages:
            if x:
                for name in (x.name, x.name + ".idx"):
                    store.fs.delete_file(store.at(name))


class WarcDataSource(DataSource):
    """Format "warc": options path, partition_bytes (reading), level (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with predicates pushed into it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_sha1(payload: F.Column) -> F.Column:
    """Upper-case base32 SHA-1 of a binary column, by built-in functions: eight digits for each ten hexadecimal ones."""
    digest = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A record a page; of records with equal payloads of least_bytes or more, those below the largest page_id revisit it.

    The largest id of each digest is aggregated before anything is joined, and
    only digests that occur again are joined back.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_length", F.length("payload").cast("long"))
    again = rows.where(F.col("payload_length") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("digest"), "keeper")
    joined = rows.join(again, F.col("payload_digest") == F.col("digest"), "left")
    revisit = (F.col("payload_length") >= least_bytes) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    urn = lambda x: F.concat(F.lit("urn:page:"), F.coalesce(x.cast("string"), F.lit("")))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.when(revisit, urn(F.col("keeper"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_id_of(column: str) -> F.Column:
    return F.nullif(F.substring_index(column, ":", -1), F.lit("")).cast("long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back; response digests are taken from the payload read."""
    register(spark)
    path = shared_dir(spark, "warc")
    page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").option("partition_bytes", 16 << 20).load(path)
    response = F.col("record_type") == "response"
    return back.select(
        page_id_of("record_id").alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page_id_of("refers_to").alias("refers_to"),
    )


OP1_SQL = r"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
k as (select hex, max(page_id) as keeper from p group by hex),
d as (select p.*, keeper, page_id is not distinct from keeper as own from p join k using (hex))
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(1 + (cast('0x' || substr(hex, cast(1 + 5 * (i // 4) as int), 5) as bigint) >> (15 - 5 * (i % 4))) % 32 as int), 1)), '') as payload_digest,
  case when own then 'response' else 'revisit' end as record_type, case when not own then keeper end as refers_to
from d
"""
