"""WARC 1.1 archives as a Spark data source (format "warc").

Writing: each task writes its rows as records to files of its own; only files named by a committed task enter the
manifest, so a lost or repeated task leaves nothing that a read sees.  Bodies are gzip-encoded HTTP responses, which keeps
them skippable: their length is in the headers.

Reading: the driver plans partitions, byte ranges at record boundaries from the manifest (without one, whole files).
Filters on record_type, target_uri, record_id, payload_digest and refers_to are pushed down; a record's headers are
parsed first, and its body is passed over by its length unless the record is wanted and the option ``payload`` asks for
it: "none" (null payload, the default), "verify" (decoded and held against its digest, then dropped), "full" (returned).

``path`` is any URI that pyarrow's file systems know (file://, hdfs://, s3://, ...) and that all executors share; a path
without a scheme is refused, for tasks would take it as one of their own machines (``cluster.qualified`` completes it).

Archives made elsewhere are read too: .warc.gz (each a partition, as members can't be told without unpacking), chunked
bodies, and digests in hex or base32 of the algorithms in _DIGESTS; digests of others are never held against a payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from .cluster import scratch_path, ship, table

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: A new file, and a new range to read, begin after so many bytes.
FILE_BYTES, RANGE_BYTES = 512 << 20, 32 << 20
MANIFEST = "_manifest.json"
BATCH_BYTES = 8 << 20
_FIXED_DATE = "2000-01-01T00:00:00Z"
#: Names of digest algorithms in headers, and those of hashlib.
_DIGESTS = {"sha256": "sha256", "sha-256": "sha256", "sha1": "sha1", "sha-1": "sha1", "md5": "md5", "sha512": "sha512", "sha-512": "sha512"}


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:/", path):
        raise ValueError(f"a URI is needed, not {path!r}")
    return fs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    """A header's value: line breaks would end it."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\n" in value or "\r" in value else value


def record(row: dict) -> bytes:
    """A record's bytes.  Null columns have no header; a revisit's body is left out."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if not revisit:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        body = packer.compress(payload) + packer.flush()
        http += b"Content-Encoding: gzip\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    else:
        http += b"\r\n"
    head = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", _FIXED_DATE), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("X-Payload-Length", str(row["payload_bytes"])), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http))),
    ]
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + http + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, list[int]]]


class WarcWriter(DataSourceArrowWriter):
    """overwrite: what was there goes, once the new manifest is in place."""

    def __init__(self, path: str, overwrite: bool = False) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _file_system(self.path)
        system.create_dir(root, recursive=True)
        files: list[tuple[str, list[int]]] = []
        out, at = None, 0
        for batch in iterator:
            for k in range(batch.num_rows):  # one row at a time: a batch's payloads are not all copied at once
                data = record({n: batch.column(n)[k].as_py() for n in batch.schema.names})
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc", 0
                    out = system.open_output_stream(posixpath.join(root, name))
                    files.append((name, [0]))
                if at - files[-1][1][-1] >= RANGE_BYTES:
                    files[-1][1].append(at)
                out.write(data)
                at += len(data)
        if out is not None:
            out.close()
            files[-1][1].append(at)
        for k, (_, starts) in enumerate(files[:-1]):
            starts.append(system.get_file_info(posixpath.join(root, files[k][0])).size)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _file_system(self.path)
        system.create_dir(root, recursive=True)
        manifest = posixpath.join(root, MANIFEST)
        listed = []
        if system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as f:
                listed = json.loads(f.read())
        new = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            names = {name for name, _ in new}
            old = [i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.base_name.endswith((".warc", ".warc.gz")) and i.base_name not in names]
            listed = []
        with system.open_output_stream(manifest) as f:
            f.write(json.dumps(listed + new).encode())
        for path in old if self.overwrite else ():
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _file_system(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                system.delete_file(posixpath.join(root, name))


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int  # -1: to the end of the file


class _Input:
    """Sequential reads over a random-access file, in blocks; ``skip`` moves on without reading what is beyond the block."""

    BLOCK = 1 << 20

    def __init__(self, file: pa.NativeFile, start: int) -> None:
        self.file, self.at, self.block, self.k = file, start, b"", 0

    def _fill(self, n: int) -> None:
        if len(self.block) - self.k < n:
            self.file.seek(self.at + len(self.block) - self.k)
            self.block = self.block[self.k :] + self.file.read(max(n - (len(self.block) - self.k), self.BLOCK))
            self.k = 0

    def read(self, n: int) -> bytes:
        self._fill(n)
        out = self.block[self.k : self.k + n]
        self.k, self.at = self.k + len(out), self.at + len(out)
        return out

    def skip(self, n: int) -> None:
        self.at += n
        if self.k + n <= len(self.block):
            self.k += n
        else:
            self.block, self.k = b"", 0

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the mark, which is passed; None at the end."""
        n = self.BLOCK
        while True:
            self._fill(n)
            found = self.block.find(mark, self.k)
            if found >= 0:
                out = self.block[self.k : found]
                self.at += found + len(mark) - self.k
                self.k = found + len(mark)
                return out
            if len(self.block) - self.k < n:
                return None
            n *= 2


class _Stream(_Input):
    """The same over a stream that can't seek: what is skipped is read and dropped."""

    def _fill(self, n: int) -> None:
        while len(self.block) - self.k < n:
            more = self.file.read(max(n - (len(self.block) - self.k), self.BLOCK))
            if not more:
                break
            self.block, self.k = self.block[self.k :] + more, 0

    def skip(self, n: int) -> None:
        while n > 0:
            got = len(self.read(min(n, self.BLOCK)))
            if not got:
                break
            n -= got


def _headers(raw: bytes) -> dict[str, str]:
    """Header lines by lower-case name; what isn't UTF-8 is Latin-1."""
    try:
        lines = raw.decode("utf-8", "surrogatepass").split("\r\n")
    except UnicodeDecodeError:
        lines = raw.decode("latin-1").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _plain(value: str | None) -> str | None:
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if value and ("%0A" in value or "%0D" in value) else value


def _hex(digest: str | None) -> tuple[str | None, str | None]:
    """Algorithm (None: not one of _DIGESTS) and lower-case hex of a digest header; what is neither hex nor base32 stays as it is."""
    if not digest:
        return None, None
    name, _, value = digest.rpartition(":")
    algorithm = _DIGESTS.get(name.strip().lower())
    if algorithm:
        size = hashlib.new(algorithm).digest_size
        if len(value) == 2 * size:
            return algorithm, value.lower()
        try:
            raw = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
        except ValueError:
            return None, value
        return (algorithm, raw.hex()) if len(raw) == size else (None, value)
    return None, value


def _columns(head: dict[str, str]) -> dict:
    digest, size = head.get("warc-payload-digest"), head.get("x-payload-length")
    return {
        "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "target_uri": _plain(head.get("warc-target-uri")),
        "payload_digest": _hex(digest)[1], "payload_bytes": int(size) if size else None, "refers_to": head.get("warc-refers-to"), "payload": None,
    }


def _unchunked(body: bytes) -> bytes:
    """The data of a chunked body, as far as it goes."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def _bodies(block: bytes) -> list[bytes]:
    """A response's body, decoded, and the forms before each decoding after it."""
    http, _, body = block.partition(b"\r\n\r\n")
    head, out = _headers(http), [body]
    if "chunked" in head.get("transfer-encoding", "").lower():
        out.insert(0, _unchunked(out[0]))
    if head.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            out.insert(0, zlib.decompressobj(47).decompress(out[0]))
        except zlib.error:
            pass  # the header is wrong: the body stays as it came
    return out


#: Records whose block is their payload as it stands; those that tell of others (warcinfo, request, metadata) have none.
_PLAIN = ("resource", "conversion")
_PUSHED = {"record_type", "target_uri", "record_id", "payload_digest", "refers_to"}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str) -> None:
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                kind = "in" if isinstance(f, In) else "equal" if isinstance(f, EqualTo) else "starts"
                self.tests.append((f.attribute[0], kind, tuple(f.value) if kind == "in" else f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, root = _file_system(self.path)
        manifest = posixpath.join(root, MANIFEST)
        if system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as f:
                listed = json.loads(f.read())
            return [Range(name, a, b) for name, starts in listed for a, b in zip(starts, starts[1:], strict=False)] or [Range("", 0, 0)]
        found = [i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.base_name.endswith((".warc", ".warc.gz"))]
        return [Range(name, 0, -1) for name in sorted(found)] or [Range("", 0, 0)]

    def _wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            got = row[name]
            if got is None or not (got in value if kind == "in" else got == value if kind == "equal" else got.startswith(value)):
                return False
        return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, root = _file_system(self.path)
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in (c.split()[0] for c in SCHEMA.split(", "))])
        rows, held = [], 0
        packed = partition.file.endswith(".gz")
        opened = system.open_input_stream if packed else system.open_input_file
        with opened(posixpath.join(root, partition.file), **({"compression": None} if packed else {})) as file:
            source = _Stream(gzip.GzipFile(fileobj=file), 0) if packed else _Input(file, partition.start)
            while partition.end < 0 or source.at < partition.end:
                raw = source.until(b"\r\n\r\n")
                if raw is None:
                    break
                head = _headers(raw)
                row, size = _columns(head), int(head.get("content-length", "0"))
                if not self._wanted(row):
                    source.skip(size + 4)
                    continue
                if self.payload == "none" or row["record_type"] not in ("response", *_PLAIN):
                    source.skip(size + 4)
                else:
                    block = source.read(size)
                    bodies = [block] if row["record_type"] in _PLAIN else _bodies(block)
                    body = bodies[0]
                    source.skip(4)
                    algorithm = _hex(head.get("warc-payload-digest"))[0]
                    right = algorithm is None or any(hashlib.new(algorithm, b).hexdigest() == row["payload_digest"] for b in bodies)
                    if self.payload == "verify" and not (right and row["payload_bytes"] in (None, len(body))):
                        raise ValueError(f"{partition.file}: the payload of {row['record_id']} does not match its digest")
                    if self.payload == "full":
                        row["payload"] = body
                        held += len(body)
                rows.append(row)
                if len(rows) >= 4096 or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "none"))

    def writer(self, schema: object, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: Payloads from this size are stored once.
REVISIT_BYTES = 100


def records(pages: DataFrame) -> DataFrame:
    """A record per row of ``pages`` (page_id, url, html), in the source's columns.

    Of rows with equal payloads of at least REVISIT_BYTES the one with the smallest page_id is a response and the others
    revisit it.  Null html: an empty payload.  Null url: no target.  Null page_id: always a response, without an id.
    Rows that repeat a page_id with its payload are all responses.
    """
    rows = pages.select("page_id", F.col("url").alias("target_uri"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("other")).where("first != other").drop("other")
    joined = rows.join(first, "payload_digest", "left").withColumn("revisit", F.coalesce(F.col("page_id") != F.col("first"), F.lit(False)))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return joined.select(
        urn("page_id").alias("record_id"), F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), "target_uri", "payload_digest", "payload_bytes",
        F.when(F.col("revisit"), urn("first")).alias("refers_to"), F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
    )


def page_of(record_id: str) -> F.Column:
    return F.regexp_extract(F.col(record_id), "^<urn:page:(.*)>$", 1)


# ---- query ------------------------------------------------------------------------------------------------------


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back with every payload decoded and verified."""
    register(spark)
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    records(pages).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").option("payload", "verify").load(path)
    return back.select(page_of("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), page_of("refers_to").cast("long")).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
