"""WARC archives, written and read by a Python data source.

Writing: a record (headers and payload) is put together in the JVM; each task writes
its records to files of its own in a folder aside, and only the files of tasks that
succeeded are moved into place when the job ends. Compressed archives have a gzip member
for each record, as the format asks, and each member's header tells its length in an
extra field ("SL": 8 bytes for the member, 8 for what it holds, little-endian).

Reading: ``WarcDataSource`` plans its partitions by file (several small files
to a partition), takes over predicates on record type and other header
columns, parses the headers of a record first and passes over the payload of a
record that isn't wanted by a seek: in a plain file by the record's length, in a
compressed one by the member's, so that no more than the headers is inflated. Compressed
files without such lengths are read as one stream. Without the option ``payload`` no
payload is read at all. An archive that ends within a payload that is read, a record without
a valid Content-Length, and a damaged member are errors.

Defined results: a null html is an empty payload; a null url has no
WARC-Target-URI and reads back as null; line ends in a url are written as %0D
and %0A. Rows with equal payloads of ``least`` bytes or more form a group: the
row with the largest page_id is a response, as are copies of that very row; the
others revisit it. A null page_id is smaller than any other; where a group has
no other page_id, all its rows are responses. Other columns are ignored; an
empty table gives archives without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import fresh_path, table

END = "\r\n"
#: Rows of one archive file and bytes of one partition of files at most.
FILE_RECORDS, PARTITION_BYTES = 50_000, 64 << 20
SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, content_type string, content_length bigint, block_offset bigint, http_header string, payload_length bigint, payload binary, path string"
_HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
#: The base32 alphabet of RFC 4648.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a digest of 20 bytes in hexadecimal: five digits are 20 bits, four letters."""
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def write(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:  # or "none"
    """A record for each row of pages (page_id, url, html): response, or revisit of an equal payload.

    The largest page_id of a digest is found by a partial aggregation, so a group
    of copies of any size moves one row a task; the join back is an ordinary one,
    whose hot keys adaptive execution splits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    first = narrow.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")).filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    identity = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    record = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", identity),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(f">{END}"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        line("Content-Length", length.cast("string")),
        F.lit(END),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    pages.sparkSession.dataSource.register(WarcDataSource)
    rows.select(record.cast("binary").alias("record")).write.format("warc").option("compression", compression).mode("append").save(path)


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has written."""

    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Records as they come, at most FILE_RECORDS to a file."""

    def __init__(self, options: dict):
        self.path, self.gzip = options["path"], options.get("compression", "gzip") == "gzip"
        self.aside = f"{self.path.rstrip('/')}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, aside = _file_system(self.aside)
        fs.create_dir(aside, recursive=True)
        names, out, n = [], None, 0
        for batch in iterator:
            for record in batch.column(0):
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' * self.gzip}")
                    out, n = fs.open_output_stream(f"{aside}/{names[-1]}", compression=None), 0
                raw = record.as_py() + b"\r\n\r\n"
                out.write(member(raw) if self.gzip else raw)
                n += 1
                if n == FILE_RECORDS:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written]) -> None:
        fs, aside = _file_system(self.aside)
        for name in [n for m in messages if m is not None for n in m.names]:
            fs.move(f"{aside}/{name}", f"{aside.rsplit('/', 1)[0]}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        fs, aside = _file_system(self.aside)
        fs.create_dir(aside, recursive=True)
        fs.delete_dir(aside)


def member(raw: bytes) -> bytes:
    """raw as one gzip member that tells its own length."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    extra = b"SL" + struct.pack("<HQQ", 16, 12 + 20 + len(body) + 8, len(raw))
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class FilePart(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality and membership on header columns are applied here, the rest by Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in _HEADERS:
                self.wanted.append((column, frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files by size, several small ones to a partition."""
        fs, root = _file_system(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pa.fs.FileType.File else fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == pa.fs.FileType.File and not f.base_name.startswith(("_", ".")))
        parts: list[InputPartition] = []
        group, total = [], 0
        for path, size in files:
            if group and total + size > self.partition_bytes:
                parts.append(FilePart(group))
                group, total = [], 0
            group.append((path, size))
            total += size
        return [*parts, FilePart(group)] if group or not parts else parts

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.path)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        schema = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(f.split()[1], pa.string())) for n, f in zip(names, SCHEMA.split(", "), strict=True)])
        rows, held = [], 0
        for path, _ in partition.value:
            with fs.open_input_file(path) as raw:
                for row in (compressed if path.endswith(".gz") else records)(raw, self.wanted, self.payload):
                    rows.append({**row, "path": path})
                    held += len(row["payload"] or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


def _file_system(path: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:{path}")


class _Buffered:
    """Reads of a stream in large pieces, with a cheap way past what isn't wanted."""

    def __init__(self, stream, size: int = 1 << 20):
        self.stream, self.size, self.data, self.at, self.base = stream, size, b"", 0, 0

    def _more(self) -> bool:
        new = self.stream.read(self.size)
        self.base += self.at
        self.data, self.at = self.data[self.at :] + new, 0
        return bool(new)

    def until(self, mark: bytes, limit: int = 1 << 62) -> bytes | None:
        """Up to and with mark; None, and nothing is read, where it isn't within limit bytes."""
        start = self.at
        while (found := self.data.find(mark, start)) < 0:
            if len(self.data) - self.at >= limit:
                return None
            start = max(0, len(self.data) - self.at - len(mark) + 1)
            if not self._more():
                return None
        if found + len(mark) - self.at > limit:
            return None
        out = self.data[self.at : found + len(mark)]
        self.at = found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) - self.at < n and self._more():
            pass
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        held = len(self.data) - self.at
        if n <= held:
            self.at += n
            return
        self.base += self.at + n
        self.data, self.at = b"", 0
        self.stream.seek(self.base)

    def tell(self) -> int:
        return self.base + self.at


class _Member:
    """What one gzip member holds, inflated piece by piece; a seek gives up the rest of it."""

    def __init__(self, read: _Buffered, size: int):
        self.raw, self.left, self.inflate, self.crc = read, size, zlib.decompressobj(-15), 0

    def read(self, _: int) -> bytes:
        while self.left:
            piece = self.raw.take(min(self.left, 1 << 14))
            if not piece:
                raise ValueError("the archive ends within a member")
            self.left -= len(piece)
            out = self.inflate.decompress(piece)
            self.crc = zlib.crc32(out, self.crc)
            if not self.left and self.inflate.unused_data[:4] != struct.pack("<I", self.crc):
                raise ValueError("a member of the archive is damaged")
            if out:
                return out
        return b""

    def seek(self, _: int) -> None:
        self.raw.skip(self.left)
        self.left = 0


def compressed(raw, wanted: list[tuple[str, frozenset]], payload: bool) -> Iterator[dict]:
    """The records of a compressed file, member by member where members tell their length, else as one stream."""
    read = _Buffered(raw)
    while head := read.take(12):
        start = read.tell() - len(head)
        extra = read.take(struct.unpack("<H", head[10:])[0]) if len(head) == 12 and head[:4] == b"\x1f\x8b\x08\x04" else b""
        if extra[:4] != b"SL\x10\0" or len(extra) != 20:
            raw.seek(start)
            yield from records(gzip.GzipFile(fileobj=raw), wanted, payload)
            return
        one = _Member(read, struct.unpack("<Q", extra[4:12])[0] - 32)
        yield from records(one, wanted, payload)
        one.seek(0)


def parse_header(head: bytes) -> dict[str, str]:
    """The named fields of a record's or an HTTP message's header; folded lines are joined, the first of equal names counts."""
    fields: dict[str, str] = {}
    last = None
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            fields[last] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields.setdefault(last, value.strip())
    return fields


def records(stream, wanted: list[tuple[str, frozenset]], payload: bool) -> Iterator[dict]:
    """The records of a stream that have the wanted header values; of the others only the header is read."""
    read = _Buffered(stream)
    while (head := read.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {head[:40]!r}")
        fields = parse_header(head)
        if not (told := fields.get("content-length", "")).isdecimal():
            raise ValueError(f"a record without a valid Content-Length: {head[:40]!r}")
        length = int(told)
        row = {column: fields.get(name) for column, name in _HEADERS.items()}
        if any(row[column] not in values for column, values in wanted):
            read.skip(length)
            continue
        row |= {"content_length": length, "block_offset": read.tell(), "http_header": None, "payload_length": length, "payload": None}
        rest = length
        if (row["content_type"] or "").startswith("application/http") and length:
            http = read.until(b"\r\n\r\n", length) or b""
            rest = length - len(http)
            row["http_header"] = http.decode("utf-8", "replace")
            row["payload_length"] = int(parse_header(http).get("content-length", rest))
        if payload:
            row["payload"] = read.take(rest)
            if len(row["payload"]) < rest:
                raise ValueError("the archive ends within a record")
        else:
            read.skip(rest)
        yield row


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def host(url: str | None) -> str | None:
    """The host of a target, lower-cased; None without one."""
    try:
        return urlsplit(url or "").hostname
    except ValueError:
        return None


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    page = lambda column: F.regexp_extract(column, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    responses = read(spark, path).filter("record_type = 'response'")
    revisits = read(spark, path, payload=False).filter("record_type = 'revisit'")
    made = responses.select(
        page("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    again = revisits.select(
        page("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.substring("payload_digest", 6, 32).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
    return made.unionByName(again)


OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first_id FROM p),
t AS (SELECT *, first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id AS again FROM g)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM t
"""
