"""WARC archives as a Spark data source: format ``warc`` after ``register(spark)``.

Reading plans one partition per archive file, or several for a large one whose records carry skip lengths
(each part starts at the first record at or after its offset). Of every record the named headers are
parsed first; predicates on ``record_type`` and on the other header columns are pushed down and decided
there, and the payload of a record that fails, or whose payload column isn't asked for, is never
decoded: the reader seeks past it by the skip length (gzip extra field ``sl``), or, where a foreign file
has none, inflates without keeping.

Writing makes one file per task, records gzipped one by one. A revisit record holds the HTTP header of
the response it refers to, and no payload.

Files are reached through ``pyarrow.fs``, so local, HDFS and object store folders do.

Defined results: a null payload is empty; columns that aren't WARC columns are refused by name when
written; rows are written as often as they come; an empty table writes no record and reads back empty.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from loomwright.llm.common import new_path

#: Payloads below this are stored as often as they come.
REVISIT_BYTES = 1000
#: Bytes of one read partition of a large file.
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
#: Column and header of each named field.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, content_type string, payload_bytes long, payload binary"
DATE = "1970-01-01T00:00:00Z"


#: How a member with a skip length begins here.
MARK = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl"


def gzip_member(head: bytes, body: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` has its own length and its plain length."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = squeeze.compress(head) + squeeze.compress(body) + squeeze.flush()
    plain = head + body
    size = 12 + 12 + len(packed) + 8
    return MARK + struct.pack("<HII", 8, size, len(plain)) + packed + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def skip_length(start: bytes) -> int | None:
    """The member's length from its first 24 bytes, if it says."""
    if len(start) >= 24 and start[:3] == b"\x1f\x8b\x08" and start[3] & 4 and start[12:14] == b"sl":
        return struct.unpack("<I", start[16:20])[0]
    return None


@dataclass
class FilePart(InputPartition):
    path: str
    start: int
    stop: int

    def __init__(self, path: str, start: int, stop: int):
        super().__init__(path)
        self.path, self.start, self.stop = path, start, stop


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.names
        self.path, self.wanted = options["path"], options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.allowed: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take equality and membership of header columns; hand back the rest."""
        for one in filters:
            name = one.attribute[0] if hasattr(one, "attribute") and len(one.attribute) == 1 else ""
            if name in HEADERS and isinstance(one, EqualTo | In):
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.allowed[name] = self.allowed.get(name, values) & values
            else:
                yield one

    def partitions(self) -> list[FilePart]:
        """Planned from names and sizes alone; what can be split is seen where it is read."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if fs.get_file_info(root).type != pafs.FileType.File else [fs.get_file_info(root)]
        parts = []
        for info in sorted(found, key=lambda x: x.path):
            if info.is_file and info.path.endswith((".warc", ".warc.gz")):
                step = max(1, self.split if info.path.endswith(".gz") else info.size)
                parts += [FilePart(info.path, at, min(at + step, info.size)) for at in range(0, info.size, step)]
        return parts

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows: list[dict] = []
        size = 0
        with fs.open_input_file(partition.path) as file:
            records = self._members(file, partition) if partition.path.endswith(".gz") else self._plain(file)
            for headers, payload_bytes, payload in records:
                rows.append({c: headers.get(HEADERS[c]) for c in HEADERS} | {"payload_bytes": payload_bytes, "payload": payload})
                size += 500 + len(payload or b"")
                if size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.columns], self.columns)

    def _passes(self, headers: dict[str, str]) -> bool:
        return all(headers.get(HEADERS[c]) in values for c, values in self.allowed.items())

    def _members(self, file: pa.NativeFile, part: FilePart) -> Iterator[tuple[dict, int, bytes | None]]:
        """Records of the members from the first marked one in the part to the first marked one behind it, or the end.

        A member without a mark (its skip length in the way this writer says it) so belongs to the part of the marked one
        before it, whatever stands at a border.
        """
        at, total = part.start, file.size()
        if at:
            at = self._next_member(file, at, min(part.stop, total), total)
        while at < total:
            file.seek(at)
            start = file.read(4096)
            if at >= part.stop and start.startswith(MARK):
                return
            length = skip_length(start)
            inflate = zlib.decompressobj(31)
            plain = inflate.decompress(start)
            while (cut := plain.find(b"\r\n\r\n")) < 0 and not inflate.eof:
                more = file.read(4096)
                if not more:
                    break
                plain += inflate.decompress(more)
            headers = parse_fields(plain[:cut]) if cut >= 0 and plain.startswith(b"WARC/") else {}
            keep = content_length(headers) is not None and self._passes(headers)
            need = keep and self.wanted
            block = plain[cut + 4 :]
            if keep and not need:
                while b"\r\n\r\n" not in block and not inflate.eof and (more := file.read(4096)):
                    block += inflate.decompress(more)
            if need or length is None:
                parts = [block]
                step = max(1, length - len(start)) if length is not None else 1 << 16
                while not inflate.eof and (more := file.read(step)):
                    piece = inflate.decompress(more)
                    if need:
                        parts.append(piece)
                block = b"".join(parts)
            if length is None:
                length = max(1, file.tell() - at - len(inflate.unused_data))
            if keep:
                yield (headers, *http_payload(headers, block, need))
            at += length

    @staticmethod
    def _next_member(file: pa.NativeFile, at: int, stop: int, total: int) -> int:
        """The first marked member from ``at`` to ``stop``, one whose skip length leads to another member or the end; else the end."""
        base = at
        while base < stop:
            file.seek(base)
            window = file.read(1 << 20)
            k = window.find(MARK)
            while k >= 0:
                if base + k >= stop:
                    return total
                file.seek(base + k)
                nxt = base + k + (skip_length(file.read(24)) or 0)
                file.seek(min(nxt, total))
                if nxt == total or nxt > base + k and file.read(3) == b"\x1f\x8b\x08":
                    return base + k
                k = window.find(MARK, k + 1)
            if len(window) < 32:
                return total
            base += len(window) - 16
        return total

    def _plain(self, file: pa.NativeFile) -> Iterator[tuple[dict, int, bytes | None]]:
        """Records one after another. Behind a record without a valid length, the next line that opens a record is looked for."""
        held = io.BufferedReader(file, 1 << 16)
        while True:
            head = held.readline(1 << 20)
            if not head:
                return
            if not head.startswith(b"WARC/"):
                continue
            while (line := held.readline(1 << 20)).strip():
                head += line
            headers = parse_fields(head)
            size = content_length(headers)
            if size is None:
                continue
            start = held.tell()
            if self._passes(headers):
                block = held.read(size if self.wanted else min(size, 1 << 14))
                while not self.wanted and b"\r\n\r\n" not in block and len(block) < size and (more := held.read(min(size - len(block), 1 << 14))):
                    block += more
                yield (headers, *http_payload(headers, block, self.wanted))
            held.seek(start + size)


def content_length(headers: dict[str, str]) -> int | None:
    text = headers.get("Content-Length", "")
    return int(text) if text.isascii() and text.isdigit() else None


def parse_fields(head: bytes) -> dict[str, str]:
    """Named fields, continuation lines joined; the version line is left out."""
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip()
            fields[name] = value.strip()
    return fields


def http_payload(headers: dict[str, str], block: bytes, need: bool) -> tuple[int, bytes | None]:
    """Length and content of the payload: what follows the HTTP header, in other blocks all.

    A revisit has the length that its HTTP header says, and no content. An HTTP block without an end of its header has none.
    """
    size = content_length(headers) or 0
    if not headers.get("Content-Type", "").startswith("application/http"):
        return size, block[:size] if need else None
    cut = block.find(b"\r\n\r\n")
    start = cut + 4 if 0 <= cut <= size - 4 else size
    if headers.get("WARC-Type") == "revisit":
        said = content_length(parse_fields(block[: max(0, cut)]))
        return said if said is not None else size - start, None
    return size - start, block[start:size] if need else None


@dataclass
class Written(WriterCommitMessage):
    path: str


class WarcWriter(DataSourceArrowWriter):
    """Columns record_type, record_id, target_uri, payload_digest, refers_to, payload_bytes, payload."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        unknown = set(schema.names) - {*HEADERS, "payload_bytes", "payload"}
        if unknown:
            raise ValueError(f"not WARC columns: {sorted(unknown)}")
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{uuid.uuid4().hex}.warc.gz"
        file = None
        for batch in iterator:
            for row in batch.to_pylist():
                if file is None:
                    file = fs.open_output_stream(f"{name}.tmp", compression=None)
                file.write(gzip_member(*record(row)))
        if file is not None:
            file.close()
        return Written(name if file is not None else "")

    def commit(self, messages: list[Written]) -> None:
        """Files get their names only here, so that a task that ran twice counts once."""
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            if message and message.path:
                fs.move(f"{message.path}.tmp", message.path)

    def abort(self, messages: list[Written]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            if message and message.path:
                fs.delete_file(f"{message.path}.tmp")


def record(row: dict) -> tuple[bytes, bytes]:
    """Header and block of one record."""
    payload = row.get("payload") or b""
    length = row["payload_bytes"] if row.get("payload_bytes") is not None else len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if row["record_type"] == "revisit" else http + payload
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row.get("record_id")), ("WARC-Date", row.get("warc_date") or DATE), ("WARC-Target-URI", row.get("target_uri"))]
    fields += [("WARC-Payload-Digest", row.get("payload_digest")), ("WARC-Refers-To", row.get("refers_to"))]
    if row["record_type"] == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    fields += [("Content-Type", row.get("content_type") or "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    head = "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode(), block + b"\r\n\r\n"


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, self.options)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A WARC row per page. Of equal payloads of ``REVISIT_BYTES`` or more, that with the largest id is the response.

    The digests are grouped with partial aggregation; the payloads move once, to meet the responses' ids.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    firsts = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(firsts.withColumnsRenamed({"digest": "d", "size": "s"}), (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("id")).alias("record_id"), F.col("url").alias("target_uri"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"), F.when(revisit, name(F.col("response"))).alias("refers_to"),
        F.col("size").cast("long").alias("payload_bytes"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def register(spark: SparkSession) -> None:
    """Make format ``warc`` known, and let predicates reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_pages(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)


def _page(field: Column) -> Column:
    return F.regexp_extract(field, r"^<urn:page:(.*)>$", 1).cast("long")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write an archive of all pages to the shared folder and read it back.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Digest and length of a response come
    from the payload that was read; those of a revisit from its headers, with no payload decoded.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_pages(pages, path)
    source = spark.read.format("warc").option("path", path)
    responses = source.load().where(F.col("record_type") == "response").select(
        F.col("record_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to"
    )
    revisits = source.option("payload", "false").load().where(F.col("record_type") == "revisit").select("record_id", "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(revisits).select(_page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page(F.col("refers_to")).alias("refers_to"))
