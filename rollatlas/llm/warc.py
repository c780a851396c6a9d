"""WARC archives as a Python data source, and an archive writer with revisit records (operator 6).

Reading plans groups of files as partitions. Predicates on the record type and on header fields
are pushed down: a record's headers are parsed first, and where they do not match, or where the
payload is not asked for, the payload is not decoded. Members written here carry their packed
length in the gzip header (subfield ``sl``), so that a record can be stepped over without
inflating it; members of other writers are inflated to find their end, and thrown away.

Writing takes Arrow batches, one gzip member a record. Tasks write files of their own; only the
files of tasks that succeeded are named in the manifest that the commit writes, so a task that is
repeated leaves nothing that a reader sees.

Files are opened with ``pyarrow.fs``, so paths may lie on local disk or on any store it knows.
Null header fields are left out and read back as null; null payloads are written as empty. Line
breaks in header fields are written as spaces. An empty table gives an archive without records.
Repeated rows are records of their own: of equal payloads one with the smallest page_id is the
response, a row that repeats that page_id too. A very long payload is one record, held whole by the
task that reads or writes it. Columns of pages other than page_id, url and html are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string,"
    " refers_to string, payload_length long, payload binary"
)
#: Header field of each column that predicates can be pushed to.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
    "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
MANIFEST = "_records.json"
#: Bytes of archive files for one task, and bytes after which a writer begins a new file.
TASK_BYTES = 128 << 20
FILE_BYTES = 64 << 20
#: Payload bytes in one Arrow batch.
BATCH_BYTES = 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = struct.Struct("<2sBBIBB")


def place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def member(raw: bytes, level: int = 1) -> bytes:
    """One gzip member that tells its packed and unpacked length."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    head = _GZIP.pack(b"\x1f\x8b", 8, 4, 0, 0, 255)
    extra = b"sl" + struct.pack("<HII", 8, len(head) + 14 + len(body) + 8, len(raw) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(columns: dict, payload: bytes, length: int) -> bytes:
    """A record as bytes. A revisit has the headers of the payload it refers to, but not its bytes."""
    text = lambda v: " ".join(str(v).split("\r\n")).replace("\n", " ").replace("\r", " ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload
    lines = ["WARC/1.1"]
    names = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Payload-Digest", "payload_digest"), ("WARC-Refers-To", "refers_to"),
    )
    lines += [f"{name}: {text(columns[key])}" for name, key in names if columns.get(key) is not None]
    if columns.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str]:
    """Lower-case header names of one block of lines; folded lines join the one before."""
    found: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def _header_end(raw: bytes) -> tuple[int, int] | None:
    """Where the header lines end and where the block begins."""
    a, b = raw.find(b"\r\n\r\n"), raw.find(b"\n\n")
    if a >= 0 and (b < 0 or a < b):
        return a, a + 4
    return (b, b + 2) if b >= 0 else None


@dataclass
class Archive:
    """Walks the records of one file; ``counts`` tells how many payloads were decoded."""

    source: pa.NativeFile
    size: int
    counts: dict[str, int] = field(default_factory=lambda: {"records": 0, "decoded": 0})

    def records(self, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
        """(headers, payload length, payload) of the records whose headers are ``wanted``."""
        at = 0
        while at < self.size:
            self.source.seek(at)
            head = self.source.read(64 << 10)
            if head[:2] == b"\x1f\x8b":
                found, at = yield from self._packed(at, head, wanted, payloads)
            elif head.strip(b"\r\n") == b"" and len(head) < 64 << 10:
                break
            else:
                found, at = yield from self._plain(at, head, wanted, payloads)

    def _emit(self, headers, first, whole, payloads: bool):
        """Split the protocol headers of a response off its payload.

        ``first`` gives so many bytes of the block; more of it are asked for until the headers end.
        """
        start = 0
        length = None
        if headers.get("content-type", "").startswith("application/http"):
            asked, block_head = 64 << 10, first(64 << 10)
            while (end := _header_end(block_head)) is None and len(block_head) == asked:
                asked *= 4
                block_head = first(asked)
            if end:
                start = end[1]
                told = parse_headers(block_head[: end[0]]).get("content-length", "")
                length = int(told) if told.isdigit() else None
        size = int(headers.get("content-length", 0))
        revisit = headers.get("warc-type") == "revisit"
        payload = None
        if payloads and not revisit:
            self.counts["decoded"] += 1
            payload = whole()[start:size]
        return headers, length if revisit and length is not None else size - start, payload

    def _plain(self, at: int, head: bytes, wanted, payloads: bool):
        skip = len(head) - len(head.lstrip(b"\r\n"))
        at, head = at + skip, head[skip:]
        while (end := _header_end(head)) is None:
            more = self.source.read(1 << 20)
            if not more:
                return None, self.size
            head += more
        headers = parse_headers(head[: end[0]])
        size, start = int(headers.get("content-length", 0)), at + end[1]
        self.counts["records"] += 1
        if wanted(headers):
            def first(n: int) -> bytes:
                self.source.seek(start)
                return self.source.read(min(n, size))

            yield self._emit(headers, first, lambda: first(size), payloads)
        return headers, start + size

    def _packed(self, at: int, head: bytes, wanted, payloads: bool):
        length = None
        if head[3] & 4:
            extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
            while len(extra) >= 4:
                size = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and size == 8:
                    length = struct.unpack_from("<I", extra, 4)[0]
                extra = extra[4 + size :]
        inflate = zlib.decompressobj(31)
        raw, fed = inflate.decompress(head, 64 << 10), len(head)
        full = len(raw) == 64 << 10

        def more(limit: int) -> bool:
            nonlocal raw, fed, full
            rest = inflate.unconsumed_tail
            # After a full answer there may be output left without any new input.
            if not rest and not full:
                self.source.seek(at + fed)
                rest = self.source.read(1 << 20)
                fed += len(rest)
            out = inflate.decompress(rest, limit)
            full = len(out) == limit
            raw += out
            return bool(rest or out)

        while (end := _header_end(raw)) is None and not inflate.eof and more(64 << 10):
            pass
        if end is None:
            headers, size, start, fit = {}, 0, 0, False
        else:
            headers = parse_headers(raw[: end[0]])
            size, start = int(headers.get("content-length", 0)), end[1]
            self.counts["records"] += 1
            fit = wanted(headers)
        if fit:
            def first(n: int) -> bytes:
                end = start + min(n, size)
                while len(raw) < end and not inflate.eof and more(max(64 << 10, end - len(raw))):
                    pass
                return raw[start:end]

            yield self._emit(headers, first, lambda: first(size), payloads)
        if length is None:
            # Another writer's member: its end shows only when it is inflated.
            while not inflate.eof:
                raw = b""
                if not more(8 << 20):
                    return headers, self.size
            length = fed - len(inflate.unused_data)
        return headers, at + length


def _value(headers: dict[str, str], column: str) -> str | None:
    found = headers.get(HEADERS[column])
    if found is not None and column in ("record_id", "refers_to"):
        found = found.removeprefix("<").removesuffix(">")
    return found


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.names = schema.fieldNames()
        self.payloads = "payload" in self.names
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith)):
                self.filters.append((type(f).__name__, column, f.value))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.filters.append((type(f).__name__, column, None))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for kind, column, value in self.filters:
            own = _value(headers, column)
            fits = {
                "EqualTo": lambda: own is not None and own == value,
                "EqualNullSafe": lambda: own == value,
                "In": lambda: own is not None and own in value,
                "StringStartsWith": lambda: own is not None and own.startswith(value),
                "IsNull": lambda: own is None,
                "IsNotNull": lambda: own is not None,
            }[kind]()
            if not fits:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        store, path = place(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            files = [(path, info.size)]
        else:
            manifest = store.get_file_info(f"{path}/{MANIFEST}")
            if manifest.type == fs.FileType.File:
                with store.open_input_stream(manifest.path) as f:
                    files = [(f"{path}/{name}", size) for name, size in json.loads(f.read())]
            else:
                found = store.get_file_info(fs.FileSelector(path, recursive=True))
                files = [(x.path, x.size) for x in found if x.path.endswith((".warc", ".warc.gz"))]
        groups: list[list[tuple[str, int]]] = []
        held = 0
        for file in sorted(files):
            if not groups or held + file[1] > self.task_bytes:
                groups.append([])
                held = 0
            groups[-1].append(file)
            held += file[1]
        return [InputPartition(g) for g in groups] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = place(self.path)
        rows: list[tuple] = []
        held = 0
        for path, size in partition.value:
            with store.open_input_file(path) as f:
                for headers, length, payload in Archive(f, size).records(self.wanted, self.payloads):
                    rows.append(tuple(
                        payload if n == "payload" else length if n == "payload_length" else _value(headers, n) for n in self.names
                    ))
                    held += len(payload or b"") + 200
                    if held > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        columns = list(zip(*rows)) or [()] * len(self.names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kinds.get(n, pa.string())) for n, c in zip(self.names, columns)], names=self.names
        )


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.level = int(options.get("level", 1))
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, path = place(self.path)
        store.create_dir(path, recursive=True)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        files: list[tuple[str, int]] = []
        out, size = None, 0
        for batch in iterator:
            names = [n for n in batch.schema.names if n not in ("payload", "payload_length")]
            lists = {n: batch.column(n).to_pylist() for n in names}
            payloads = batch.column("payload")
            lengths = batch.column("payload_length").to_pylist()
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{stem}-{len(files):04d}.warc.gz"
                    out, size = store.open_output_stream(f"{path}/{name}", compression=None), 0
                own = {n: v[i] for n, v in lists.items()}
                payload = b"" if own.get("record_type") == "revisit" else payloads[i].as_py() or b""
                packed = member(record(own, payload, len(payload) if lengths[i] is None else lengths[i]), self.level)
                out.write(packed)
                size += len(packed)
                if size >= self.file_bytes:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = place(self.path)
        store.create_dir(path, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        manifest = f"{path}/{MANIFEST}"
        if not self.overwrite and store.get_file_info(manifest).type == fs.FileType.File:
            with store.open_input_stream(manifest) as f:
                files = [tuple(x) for x in json.loads(f.read())] + files
        with store.open_output_stream(manifest) as f:
            f.write(json.dumps(sorted(files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = place(self.path)
        for name, _ in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{path}/{name}")


class Warc(DataSource):
    """``spark.read.format("warc").schema(...).load(path)``; a schema without ``payload`` decodes none."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def use_warc(spark: SparkSession) -> None:
    """Make the format known and let predicates through to it."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """Records of an archive file or folder; without ``payload`` among ``columns`` none is decoded."""
    use_warc(spark)
    fields = [f for f in SCHEMA.split(", ") if columns is None or f.split()[0] in columns]
    return spark.read.format("warc").schema(", ".join(fields)).options(**options).load(path)


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    """Write (record_id, record_type, target_uri, date, payload_digest, refers_to, payload_length, payload)."""
    use_warc(records.sparkSession)
    records.write.format("warc").mode("append").options(**options).save(path)


def page_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """A record for every page. Of equal payloads of ``least_bytes`` or more, the one with the
    smallest id is the response and the others revisit it; all smaller ones are responses."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"),
        F.encode(F.coalesce(F.col(body_col), F.lit("")), "utf-8").alias("payload"),
    ).withColumn("payload_length", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.col("payload_length") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return rows.join(first, "digest", "left").select(
        name("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.lit(date).alias("date"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(revisit, name("first")).alias("refers_to"), "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archived_pages(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records read back.

    A response's digest is that of the bytes read, a revisit's comes from its header.
    """
    page = lambda c: F.substring_index(F.col(c), ":", -1).try_cast("long")
    told = F.regexp_replace("payload_digest", "^sha256:", "")
    return records.select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", told).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"),
    )
