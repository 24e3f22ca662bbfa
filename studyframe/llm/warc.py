"""WARC archives: a writer with revisit records, and a reader that splits gzip archives by byte ranges.

Every record is a gzip member of its own. A reading task looks for the magic of gzip in its range, takes a hit
for a record only if the member's first bytes decode to a WARC header, and owns the records that start inside
its range, up to whatever byte they end at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyframe.llm.common import join_groups, kept

#: Payloads from this size are stored once.
REVISIT_BYTES = 1000
#: Bytes of an archive before a task begins another, and of the range that a reading task scans.
FILE_BYTES, RANGE_BYTES = 1 << 30, 8 << 20
#: Reading tasks per shuffle partition (or half a core), at most.
RANGE_WAVES = 4
READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
_PAGE = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, record_type string, target_uri string, refers_to string, http_bytes long, digest string, payload binary"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _sha1(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: {_sha1(payload)}",
        *([f"WARC-Refers-To: <{_PAGE}{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html of pages, and refers_to: of equal payloads of REVISIT_BYTES or more, all but the largest id refer to that one.

    Rows without id are responses, and so are all rows with the largest id.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    body = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.withColumn("_digest", F.when(F.octet_length(body) >= REVISIT_BYTES, F.sha2(body, 256)))
    groups = kept(rows.where("_digest is not null").groupBy("_digest").agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    total = groups.agg(F.sum("_n")).first()[0]
    if not total:
        return pages.withColumn("refers_to", F.lit(None).cast("long"))
    out = join_groups(rows, groups, "_digest", "_n", total, "page_id")
    return out.select(*pages.columns, F.when(F.col("page_id") < F.col("_largest"), F.col("_largest")).alias("refers_to"))


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Write planned pages to *.warc.gz below folder; the manifest: path, bytes, records.

    A task writes files of its own under a new name each time it runs. The manifest is written by Spark once all
    tasks are done and names the files of the attempts that counted; others are left unread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, base = _open(folder)
        system.create_dir(f"{base}/archives", recursive=True)
        done: list[tuple[str, int, int]] = []
        out = path = None
        size = records = 0
        for batch in batches:
            for key, address, body, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"archives/{uuid.uuid4().hex}.warc.gz"
                    out, size, records = system.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                data = record_bytes(key, address, body or b"", refers)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, records))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "bytes", "records"])

    rows = planned.select("page_id", F.col("url").cast("string"), F.col("html").cast("binary"), F.col("refers_to").cast("long"))
    rows.mapInArrow(run, "path string, bytes long, records long").write.parquet(f"{folder}/manifest")
    return planned.sparkSession.read.parquet(f"{folder}/manifest").withColumn("path", F.concat(F.lit(f"{folder}/"), "path"))


class _Window:
    """Bytes of a file from a moving offset on."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.data = file, at, b""

    def fill(self) -> bool:
        self.file.seek(self.at + len(self.data))
        more = self.file.read(READ_BYTES)
        self.data += more
        return bool(more)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _member(window: _Window) -> tuple[bytes, int] | None:
    """The member at the window's start and its compressed size; None if it isn't a whole WARC record."""
    unpack, out, given = zlib.decompressobj(wbits=31), [], 0
    try:
        while not unpack.eof:
            if given == len(window.data) and not window.fill():
                return None
            part = unpack.decompress(window.data[given : given + READ_BYTES])
            given = min(len(window.data), given + READ_BYTES)
            if not out and part and not b"WARC/1.".startswith(part[:7]) and not part.startswith(b"WARC/1."):
                return None
            out.append(part)
    except zlib.error:
        return None
    whole = b"".join(out)
    return (whole, given - len(unpack.unused_data)) if whole.startswith(b"WARC/1.") else None


def parse_record(raw: bytes) -> tuple | None:
    """The fields of RECORD."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    try:
        block = rest[: int(fields["content-length"])]
    except (KeyError, ValueError):
        return None
    http_bytes, payload = None, block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                http_bytes = int(value)
    bare = lambda x: x.strip("<>") if x else None
    return bare(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")), http_bytes, fields.get("warc-payload-digest"), payload


def records_in(path: str, start: int, end: int) -> Iterator[tuple]:
    """The records of an archive that start in [start, end)."""
    system, name = _open(path)
    with system.open_input_file(name) as file:
        window = _Window(file, start)
        while window.at < end:
            if len(window.data) < len(MAGIC) and not window.fill():
                return
            hit = window.data.find(MAGIC)
            if hit < 0:
                window.drop(max(0, len(window.data) - len(MAGIC) + 1))
                if not window.fill():
                    return
                continue
            window.drop(hit)
            if window.at >= end:
                return
            member = _member(window)
            if member is None:
                window.drop(1)
                continue
            window.drop(member[1])
            record = parse_record(member[0])
            if record:
                yield record


def read_archives(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the archives in files (path, bytes), read by byte range in as many tasks as there are ranges, or RANGE_WAVES per shuffle partition.

    payload is null for revisit records; http_bytes and digest are those of the whole payload either way.
    """
    spread = "spark.sql.shuffle.partitions"
    tasks = files.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / range_bytes)), F.lit(0))).first()[0]
    tasks = max(1, min(int(tasks), max(int(spark.conf.get(spread)), 2 * spark.sparkContext.defaultParallelism) * RANGE_WAVES))
    ranges = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size = [], 0
                for record in records_in(path, start, start + range_bytes):
                    held.append(record)
                    size += len(record[-1])
                    if size > READ_BYTES:
                        yield _batch(held, names)
                        held, size = [], 0
                if held:
                    yield _batch(held, names)

    # Rows say nothing of the bytes that they name, so the number of tasks is fixed: adaptive execution would merge them all.
    return ranges.repartition(tasks, F.xxhash64("path", "start")).mapInArrow(run, RECORD)


def _batch(records: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
    columns = [list(c) for c in zip(*records)]
    columns[6] = [None if kind == "revisit" else body for kind, body in zip(columns[1], columns[6])]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes of the *.warc.gz files of any folder that Spark can list."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("bytes"))


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages to archives below folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null or empty payload is a response of no bytes. Rows that repeat an id and rows without id have records of
    their own. payload_digest is bare hexadecimal SHA-1: of responses computed from what was read, of revisits as
    their record says. Further columns are ignored; an empty table gives no archive and no lines.
    """
    spark = pages.sparkSession
    records = read_archives(spark, write_archives(plan_records(pages), folder))

    def page(c: str):
        return F.regexp_extract(c, f"^{_PAGE}(-?[0-9]+)$", 1).try_cast("long")

    response = F.col("record_type") == "response"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(_hex_of_base32(F.regexp_replace("digest", "^sha1:", ""))).alias("payload_digest"),
        "record_type",
        F.when(~response, page("refers_to")).alias("refers_to"),
    )


def _hex_of_base32(text):
    """32 characters of base 32, five bits each, as 40 hexadecimal digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    eight = lambda i: F.substring(text, 8 * i + 1, 8)  # noqa: E731  40 bits each
    number = lambda i: F.conv(F.translate(eight(i), alphabet, "0123456789abcdefghijklmnopqrstuv"), 32, 16)
    return F.lower(F.concat(*(F.lpad(number(i), 10, "0") for i in range(4))))
