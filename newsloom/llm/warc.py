"""WARC archives as a Python data source, and pages stored with revisit records.

Each record is a gzip member of its own whose header carries the member's length (the ``sl`` field), so a
reader inflates the WARC headers, tests the record type and other header predicates pushed down to it, and
steps over payloads nobody asked for without decoding them.  Files are planned into partitions by size.
Every write lists its files in a ``_files-`` list of its own, and all lists of a folder are read; what failed attempts left beside
them is not.  A write with mode overwrite removes the lists before its own.  A path without scheme lies on the cluster's default file system.
A revisit names the record that it refers to as the standard says, and that record's page beside it.

Null payloads are empty payloads.  Of rows with equal payloads all with the smallest page id are response
records (one, if ids are unique); a null id is larger than any other.  A null address or id is left out of the headers and reads
back as null.  An empty table gives an archive without records.  Other columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from newsloom.llm.common import ship_package
from newsloom.operators.joins import fits_broadcast, salted_join
from newsloom.sources.feather import qualified

# Column -> header; these can be tested before any payload is decoded.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "X-Refers-To-Page",
    "refers_to_record": "WARC-Refers-To",
    "page_id": "X-Page-Id",
    "payload_length": "X-Payload-Length",
}
NUMBERS = ("refers_to", "page_id", "payload_length")
SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, "
    "refers_to long, refers_to_record string, page_id long, payload_length long, payload binary"
)
MANIFEST = "_files-"
PIECE = 1 << 20
DATE = "2000-01-01T00:00:00Z"  # of pages without a date, so that reruns write equal bytes


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path; ``qualified`` gives one without scheme the cluster's default."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def member(head: bytes, block: bytes) -> bytes:
    """One record as a gzip member with its stored and plain length in the header."""
    plain = head + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(head + b"\r\n") + packer.flush(zlib.Z_SYNC_FLUSH) + packer.compress(plain[len(head) + 2 :]) + packer.flush()
    length = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, length, len(plain) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack(
        "<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(row: dict) -> bytes:
    payload = row["payload"] or b""
    kind, digest = row["record_type"], base64.b32encode(bytes.fromhex(row["digest"])).decode()
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(row["page_id"], digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if row["url"] is None else quote(row["url"], safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-Id": row["page_id"],
        "X-Payload-Length": row["payload_bytes"],
    }
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    if kind == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = record_id(row["refers_to"], digest)
        fields["X-Refers-To-Page"] = row["refers_to"]
    block = http + payload if kind == "response" else http
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = [f"{k}: {v}\r\n" for k, v in fields.items() if v is not None]
    return member(b"WARC/1.1\r\n" + "".join(lines).encode(), block)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Rows (page_id, url, record_type, payload, digest, payload_bytes, refers_to) to ``.warc.gz`` files."""

    def __init__(self, path: str, file_bytes: int, overwrite: bool = False):
        self.path, self.file_bytes, self.overwrite = path, file_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = store(self.path)
        names, file, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if file is None:
                    fs.create_dir(base, recursive=True)
                    names.append(f"pages-{uuid.uuid4().hex}.warc.gz")
                    file, size = fs.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                data = record(row)
                file.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    file.close()
                    file = None
        if file is not None:
            file.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = store(self.path)
        fs.create_dir(base, recursive=True)
        before = manifests(fs, base) if self.overwrite else []
        with fs.open_output_stream(f"{base}/{MANIFEST}{uuid.uuid4().hex}", compression=None) as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())
        for path in before:
            fs.delete_file(path)


def manifests(fs: pafs.FileSystem, base: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted(i.path for i in found if i.base_name.startswith(MANIFEST))


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class Window:
    """A file read in pieces of a megabyte, at any place."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.at <= at or at + n > self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(min(max(n, PIECE), self.size - at))
        return self.data[at - self.at : at - self.at + n]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.columns = options["path"], [f.name for f in schema.fields]
        self.bytes = int(options.get("maxPartitionBytes", 64 << 20))
        self.tests: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((column, frozenset([f.value])))
            elif column in HEADERS and isinstance(f, In) and None not in f.value:
                self.tests.append((column, frozenset(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, base = store(self.path)
        names = []
        lists = manifests(fs, base)
        for path in lists:
            with fs.open_input_file(path) as file:
                names += [f"{base}/{n}" for n in json.loads(file.read())]
        if not lists:
            found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
            names = sorted(i.path for i in found if i.path.endswith((".warc", ".warc.gz")))
        parts, size = [[]], 0
        for info in fs.get_file_info(names) if names else []:
            if parts[-1] and size + info.size > self.bytes:
                parts.append([])
                size = 0
            parts[-1].append(info.path)
            size += info.size
        return [Files(p) for p in parts if p]

    def read(self, partition: Files) -> Iterator[tuple]:
        if partition is None:
            return
        fs, _ = store(self.path)
        for name in partition.names:
            with fs.open_input_file(name) as file:
                yield from self._file(Window(file, file.size()), name.endswith(".gz"))

    def _file(self, window: Window, packed: bool) -> Iterator[tuple]:
        at = 0
        while at < window.size:
            at, row = (self._packed if packed else self._plain)(window, at)
            if row is not None:
                yield row

    def _packed(self, window: Window, at: int):
        """The next place and the record of the member at ``at``; a member without a length is inflated to find it."""
        head = window.get(at, 24)
        flags = head[3]
        if flags == 4 and head[12:14] == b"sl":
            length = struct.unpack("<I", head[16:20])[0]
            inflater = zlib.decompressobj(31)
            data = inflater.decompress(window.get(at, min(length, 4096)), 65536)
            taken = min(length, 4096)
            while b"\r\n\r\n" not in data and taken < length:
                more = window.get(at + taken, min(65536, length - taken))
                taken += len(more)
                data += inflater.decompress(inflater.unconsumed_tail + more)
            fields = parse_headers(data)
            if not self._wanted(fields):
                return at + length, None
            if "payload" in self.columns:
                data = zlib.decompress(window.get(at, length), 31)
            return at + length, self._row(fields, data)
        inflater, data, place = zlib.decompressobj(31), b"", at
        while not inflater.eof and place < window.size:
            more = window.get(place, min(PIECE, window.size - place))
            place += len(more)
            data += inflater.decompress(more)
        fields = parse_headers(data)
        return place - len(inflater.unused_data), self._row(fields, data) if self._wanted(fields) else None

    def _plain(self, window: Window, at: int):
        n = 4096
        while b"\r\n\r\n" not in (data := window.get(at, min(n, window.size - at))) and at + n < window.size:
            n *= 2
        fields, start = parse_headers(data), data.find(b"\r\n\r\n") + 4
        length = start + int(fields.get("content-length", 0))
        row = None
        if self._wanted(fields):
            row = self._row(fields, window.get(at, length) if "payload" in self.columns else data)
        return at + length + 4, row

    def _wanted(self, fields: dict) -> bool:
        for column, values in self.tests:
            value = header(fields, column)
            if value is None or values is not None and value not in values:
                return False
        return True

    def _row(self, fields: dict, data: bytes) -> tuple:
        payload = None
        if "payload" in self.columns and fields.get("warc-type") != "revisit":
            start = data.find(b"\r\n\r\n") + 4
            block = data[start : start + int(fields.get("content-length", 0))]
            payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        return tuple(payload if c == "payload" else header(fields, c) for c in self.columns)


def parse_headers(data: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the version line is left out."""
    lines = data[: data.find(b"\r\n\r\n")].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def header(fields: dict[str, str], column: str):
    value = fields.get(HEADERS[column].lower()) if column in HEADERS else None
    if value is None:
        return None
    return int(value) if column in NUMBERS else value


class WarcSource(DataSource):
    """``spark.read.format("warc")``; a schema with fewer columns spares the decoding of payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", 256 << 20)), overwrite)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records below ``path``.  Predicates on header columns are tested before payloads are decoded, for
    which the session's switch for pushing filters into Python sources is turned on."""
    ship_package(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(columns).load(qualified(spark, path))


def digest_of(payload: F.Column) -> F.Column:
    """Bare upper-case base32 SHA-1 of a binary column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode())

    return F.pandas_udf(run, "string")(payload)


def write_warc(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0
) -> None:
    """A record per page: the first of equal payloads of at least ``least_bytes`` is a response, the others
    revisit it.  Only payloads that occur again are joined back, by digest and length."""
    payload = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    again = (
        rows.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("digest", "payload_bytes")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .select("digest", "payload_bytes", "_first", F.lit(True).alias("_again"))
    )
    revisit = F.coalesce(F.col("_again") & ~F.col("page_id").eqNullSafe(F.col("_first")), F.lit(False))
    if fits_broadcast(again):
        joined = rows.join(F.broadcast(again), ["digest", "payload_bytes"], "left")
    else:  # one payload may be that of any share of the pages
        joined = salted_join(rows, again.drop("payload_bytes"), "digest", F.col("page_id"), "left")
    typed = joined.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(~revisit, F.col("payload")).alias("payload"), "digest", "payload_bytes",
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )
    ship_package(pages.sparkSession)
    pages.sparkSession.dataSource.register(WarcSource)
    typed.write.format("warc").mode("append").save(qualified(pages.sparkSession, path))
