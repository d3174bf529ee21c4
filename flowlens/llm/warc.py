"""WARC archives as a Spark data source, and the archive of a page table with revisit records.

Written archives hold one gzip member for each record, with its compressed and full length in the member's extra
field "sl" (skip lengths, WARC 1.0 annex). A reader that does not want a record inflates its header only and seeks on.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from flowlens.llm.common import scratch_path, written

SCHEMA = "record_type string, record_id string, url string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: Header fields of the columns that filters can be pushed to.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "url": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
BYTES_HEADER = "x-payload-bytes"
HEAD = 4096


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _field(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record_bytes(row: dict) -> bytes:
    """A record of the columns record_type, record_id, url, date, payload and refers_to. A revisit has the digest and length of its payload, not the payload."""
    payload = row.get("payload") or b""
    body = b"" if row["record_type"] == "revisit" else payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['date']}"]
    if row.get("url") is not None:
        lines.append(f"WARC-Target-URI: {_field(row['url'])}")
        if _field(row["url"]) != row["url"]:
            lines.append("X-Target-URI-Escaped: line-breaks")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += [f"X-Payload-Bytes: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """data as one gzip member with skip lengths."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 24 + len(body) + 8
    skip = (size, len(data)) if max(size, len(data)) < 1 << 32 else (0, 0)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, *skip) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _head(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _skip_length(extra: bytes) -> int:
    while len(extra) >= 4:
        n = struct.unpack("<H", extra[2:4])[0]
        if extra[:2] == b"sl" and n == 8:
            return struct.unpack("<I", extra[4:8])[0]
        extra = extra[4 + n :]
    return 0


def records(f, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header fields, payload) of the records of an open archive, gzipped by record or plain. wanted(fields): None to leave a record out, else whether its payload is needed."""
    size, at = f.size(), 0
    while at < size:
        f.seek(at)
        start = f.read(HEAD)
        if start[:2] != b"\x1f\x8b":  # plain: a header, then Content-Length bytes
            blank = len(start) - len(start.lstrip(b"\r\n"))
            if blank:  # lines between records, however many
                at += blank
                continue
            while b"\r\n\r\n" not in start and len(more := f.read(HEAD)):
                start += more
            head, sep, _ = start.partition(b"\r\n\r\n")
            if not sep:
                raise ValueError(f"no record begins at {at}")
            fields = _head(head)
            begin, n = at + len(head) + len(sep), int(fields.get("content-length", 0))
            need = wanted(fields)
            if need is not None:
                f.seek(begin)
                yield fields, f.read(n) if need else None
            at = begin + n + 4
            continue
        extra = struct.unpack("<H", start[10:12])[0] if start[3] & 4 else 0
        if len(start) < 12 + extra:  # a header longer than HEAD
            start += f.read(12 + extra - len(start))
        skip = _skip_length(start[12 : 12 + extra])
        z = zlib.decompressobj(31)
        data = z.decompress(start, HEAD)
        fed = len(start)

        def inflate(until: int | None) -> None:
            nonlocal data, fed
            while not z.eof and (until is None and b"\r\n\r\n" not in data or until is not None and len(data) < until):
                chunk = z.unconsumed_tail
                if not chunk:
                    f.seek(at + fed)
                    chunk = f.read(1 << 16)
                    fed += len(chunk)
                    if not chunk:
                        raise ValueError(f"archive ends within the record at {at}")
                data += z.decompress(chunk, 1 << 20)

        inflate(None)
        head = data.partition(b"\r\n\r\n")[0]
        fields = _head(head)
        begin, n = len(head) + 4, int(fields.get("content-length", 0))
        need = wanted(fields)
        if need:
            inflate(begin + n)
        if need is not None:
            yield fields, data[begin : begin + n] if need else None
        if not skip:  # the end shows only when all is inflated
            while not z.eof:
                before = len(data)
                inflate(len(data) + 1)
                data = data[-8:] if need is not True else data
                if len(data) == before and z.eof:
                    break
            skip = fed - len(z.unused_data)
        at += skip


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    """Options: path; maxPartitionBytes (64 MB: small files share a task); verify (false: compare payloads with their digests)."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.names, options["path"]
        self.most = int(options.get("maxpartitionbytes", 64 << 20))
        self.verify = options.get("verify", "false") == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership and prefix tests on header columns are done here."""
        for x in filters:
            column = x.attribute[0] if hasattr(x, "attribute") and len(x.attribute) == 1 else None
            if column in HEADERS and isinstance(x, EqualTo) and isinstance(x.value, str):
                self.tests.append((column, "in", (x.value,)))
            elif column in HEADERS and isinstance(x, In):
                self.tests.append((column, "in", tuple(x.value)))
            elif column in HEADERS and isinstance(x, StringStartsWith):
                self.tests.append((column, "prefix", (x.value,)))
            else:
                yield x

    def partitions(self) -> list[InputPartition]:
        fs, base = _filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)) if fs.get_file_info(base).type != pafs.FileType.File else [fs.get_file_info(base)]
        files = sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz")) and "/_tmp-" not in x.path)
        out: list[InputPartition] = []
        group, size = [], 0
        for path, n in files:
            if group and size + n > self.most:
                out.append(Files(group))
                group, size = [], 0
            group, size = [*group, path], size + n
        return [*out, Files(group)] if group or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.names])
        all_payloads = "payload" in self.names

        def value(fields: dict, column: str):
            v = fields.get(HEADERS[column])
            if v is not None and column == "url" and "x-target-uri-escaped" in fields:
                return v.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
            if v is not None and column in ("record_id", "refers_to"):
                return v.strip("<>")
            return v.removeprefix("sha1:") if v is not None and column == "payload_digest" else v

        def wanted(fields: dict) -> bool | None:
            for column, test, values in self.tests:
                v = value(fields, column)
                if v is None or (v not in values if test == "in" else not v.startswith(values)):
                    return None
            return all_payloads or self.verify and fields.get("warc-type") != "revisit"  # what has a digest of its own

        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for fields, payload in records(f, wanted):
                    if self.verify and fields.get("warc-type") != "revisit":
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"{path}: {fields.get('warc-record-id')} does not have its digest")
                    row = {c: value(fields, c) for c in self.names if c in HEADERS}
                    row |= {"payload_bytes": int(fields.get(BYTES_HEADER, fields.get("content-length", 0))), "payload": payload}
                    rows.append({c: row.get(c) for c in self.names})
                    size += len(payload or b"") if "payload" in self.names else 0
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Moves(WriterCommitMessage):
    moves: list[tuple[str, str]]

    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class WarcWriter(DataSourceArrowWriter):
    """Options: path; maxFileBytes (128 MB of compressed records, then a new file). Files get their names when all tasks have ended well."""

    def __init__(self, options: dict):
        self.path, self.most, self.job = options["path"], int(options.get("maxfilebytes", 128 << 20)), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moves:
        fs, base = _filesystem(self.path)
        task, moves, out = uuid.uuid4().hex, [], None
        fs.create_dir(f"{base}/_tmp-{self.job}", recursive=True)
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or out.tell() > self.most:
                    if out is not None:
                        out.close()
                    name = f"{task}-{len(moves):05d}.warc.gz"
                    moves.append((f"{base}/_tmp-{self.job}/{name}", f"{base}/{name}"))
                    out = fs.open_output_stream(moves[-1][0], compression=None)
                out.write(gzip_member(record_bytes(row)))
        if out is not None:
            out.close()
        return Moves(moves)

    def commit(self, messages: list[Moves | None]) -> None:
        fs, base = _filesystem(self.path)
        for m in messages:
            for a, b in m.moves if m else []:
                fs.move(a, b)
        self._clear(fs, base)

    def abort(self, messages: list[Moves | None]) -> None:
        self._clear(*_filesystem(self.path))

    def _clear(self, fs, base: str) -> None:
        """The job's folder goes, with what failed attempts left in it."""
        if fs.get_file_info(f"{base}/_tmp-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/_tmp-{self.job}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make format("warc") known; filters reach Python sources only with this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, **options: str) -> DataFrame:
    """The records of the archives under path. columns: those to read; payloads are only decoded if `payload` is among them."""
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(path)


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record for each row to archives under path.

    Of rows with equal payloads of at least min_bytes, that with the smallest id is a response, the others revisit
    it; shorter payloads are all responses. Null payloads are empty, null urls leave the field out. Rows without an
    id are responses under a random id; repeated rows with the smallest id are all responses. An empty table writes
    no archive. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("_key"))
    repeated = rows.where(F.octet_length("payload") >= min_bytes).groupBy("_key").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_first")
    # Only keys that repeat: Spark knows the table's size and broadcasts it if small; else it splits hot keys.
    joined = rows.join(written(repeated, "repeated_payloads"), "_key", "left")
    again = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))
    ident = F.coalesce(F.concat(F.lit("urn:page:"), F.col("_id").cast("string")), F.concat(F.lit("urn:uuid:"), F.uuid()))
    out = joined.select(F.when(again, "revisit").otherwise("response").alias("record_type"), ident.alias("record_id"), "url", F.lit(date).alias("date"), "payload", F.when(again, F.concat(F.lit("urn:page:"), F.col("_first").cast("string"))).alias("refers_to"))
    register(pages.sparkSession)
    out.write.format("warc").mode("append").option("path", path).save()


def page_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages written to archives in the shared folder and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch_path(spark, "archives")
    archive_pages(pages, path, min_bytes)
    columns = "record_type string, record_id string, payload_digest string, payload_bytes long, refers_to string"
    # The type goes to the reader, which opens the payloads of responses only, to compare them with their digests.
    back = read_warc(spark, path, columns, verify="true").where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1), F.lit("")).cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
