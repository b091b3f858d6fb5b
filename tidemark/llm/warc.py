"""WARC archives: a writer with revisit records, and a salvage reader.

Records are gzip members of their own.  The reader checks each member (gzip trailer, version
line, lengths, block and payload digests); where a check fails it searches for the next valid
member, or in plain files the next version line, goes on from there, and returns the bytes
between as a quarantined gap.  A file is read by one task and is bounded by ``FILE_BYTES``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, new_path, whole_numbers

#: Payloads under this many bytes are never revisits.
REVISIT_BYTES = 1000
#: Digests that are checked.
ALGORITHMS = {"md5", "sha1", "sha224", "sha256", "sha384", "sha512"}
#: Bytes after which a writer starts its next file.
FILE_BYTES = 16 << 20
#: Keys over which the copies of one payload are spread when they learn of their response.
SALT = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
#: A gzip member of a foreign archive that unpacks to over so many bytes, and to over so many times its own, is a gap.
BOMB_BYTES, BOMB_RATIO = 64 << 20, 200

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, offset long, length long, kind string, reason string, record_type string, record_id string, refers_to_id string, "
    "url string, payload_bytes long, payload_digest string, payload binary"
)


class Row(NamedTuple):
    path: str
    offset: int
    length: int
    kind: str
    reason: str | None = None
    record_type: str | None = None
    record_id: str | None = None
    refers_to_id: str | None = None
    url: str | None = None
    payload_bytes: int | None = None
    payload_digest: str | None = None
    payload: bytes | None = None


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(urn: str, url: str | None, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """A response record, or a revisit record of ``refers_to`` whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _END + block + _END


def member(data: bytes) -> bytes:
    """``data`` as one gzip member, the same bytes each time."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class Broken(ValueError):
    """A record that fails a check."""


def declared(said: str | None) -> tuple[str, bytes] | None:
    """Algorithm and value of a digest header in hex, base32 or base64; None where there is none or its algorithm is unknown."""
    name, colon, value = (said or "").partition(":")
    name, bare = name.strip().lower().replace("-", ""), value.strip().rstrip("=")
    if not colon or name not in ALGORITHMS:
        return None
    size = hashlib.new(name).digest_size
    try:
        if len(bare) == 2 * size:
            return name, bytes.fromhex(bare)
        if len(bare) == -(-size * 8 // 5):
            return name, base64.b32decode(bare.upper() + "=" * (-len(bare) % 8))
        if len(bare) == -(-size * 8 // 6):
            return name, base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)
    except ValueError:
        pass
    raise Broken("malformed digest")


class Marks:
    """Next places of byte strings in ``data``; asked in ascending order, each place is searched for once."""

    def __init__(self, data: bytes):
        self.data, self.found = data, {}

    def after(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on; the end of the data if there is none."""
        low, place = self.found.get(mark, (0, -1))
        if not low <= at <= place:
            place = self.data.find(mark, at)
            place = len(self.data) if place < 0 else place
            self.found[mark] = at, place
        return place


def header_lines(data: bytes, start: int, stop: int) -> Iterator[tuple[str, str]]:
    """Names (lower case) and values of the header lines ``data[start:stop]``, up to the first malformed one.

    A line that starts with a blank goes on with the value before it.
    """
    held: tuple[bytes, bytes] | None = None

    def text(name: bytes, value: bytes) -> tuple[str, str]:
        try:
            return name.decode("latin-1"), value.strip().decode("utf-8")
        except UnicodeDecodeError:
            raise Broken("header is not UTF-8") from None

    while start < stop:
        end = data.find(b"\r\n", start, stop)
        end = stop if end < 0 else end
        line, start = data[start:end], end + 2
        if line[:1] in (b" ", b"\t") and held:
            held = held[0], held[1] + b" " + line.strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("malformed header")
        if held:
            yield text(*held)
        held = name.strip().lower(), value.strip()
    if held:
        yield text(*held)


def parse(data: bytes, at: int, path: str, offset: int, keep_payload: bool, marks: Marks | None = None) -> tuple[Row, int]:
    """The record whose version line is at ``at``, and the place after its end; raises :class:`Broken`."""
    line = re.compile(rb"WARC/\d\.\d\r\n").match(data, at)
    if not line:
        raise Broken("no version line")
    stop = (marks or Marks(data)).after(_END, at)
    if stop == len(data):
        raise Broken("header without end")
    head = dict(header_lines(data, line.end(), stop))
    length = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise Broken("no content length")
    start = stop + 4
    end = start + int(length)
    block = data[start:end]
    if len(block) < int(length) or data[end : end + 4] != _END:
        raise Broken("length mismatch")
    stated = declared(head.get("warc-block-digest"))
    if stated and hashlib.new(stated[0], block).digest() != stated[1]:
        raise Broken("block digest mismatch")
    kind, http, payload = head.get("warc-type"), b"", block
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(_END)
    stated, size = declared(head.get("warc-payload-digest")), len(payload)
    if kind == "revisit":
        found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(found[1]) if found else None
    elif stated and hashlib.new(stated[0], payload).digest() != stated[1]:
        raise Broken("payload digest mismatch")
    hexed = stated[1].hex() if stated else hashlib.sha1(payload).hexdigest()
    bare = lambda k: head[k].strip("<>") if k in head else None
    row = Row(path, offset, end + 4 - at, "record", None, kind, bare("warc-record-id"), bare("warc-refers-to"),
              head.get("warc-target-uri"), size, hexed, payload if keep_payload and kind != "revisit" else None)
    return row, end + 4


def inflate(data: bytes, at: int, step: int = 1 << 14, bomb: bool = False) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and its end; fed in steps, as what follows it is copied back.

    With ``bomb`` a member that unpacks to far more than its own bytes is given up as soon as that shows.
    """
    unpack, out, upto, size = zlib.decompressobj(31), [], at, 0
    try:
        while not unpack.eof and upto < len(data):
            out.append(unpack.decompress(data[upto : upto + step]))
            upto, size = upto + step, size + len(out[-1])
            if bomb and size > max(BOMB_BYTES, BOMB_RATIO * (upto - at)):
                raise Broken("gzip member unpacks to far more than its bytes")
    except zlib.error as e:
        raise Broken(f"gzip: {e}") from None
    if not unpack.eof:
        raise Broken("gzip member without end")
    return b"".join(out), min(upto, len(data)) - len(unpack.unused_data)


def parse_all(plain: bytes, path: str, offset: int, keep_payload: bool) -> tuple[list[Row], str | None]:
    """The records of a gzip member's content, and why the first bytes that yield none do so."""
    blank = re.compile(rb"\s*")
    rows, why, at, marks = [], None, 0, Marks(plain)
    while not blank.fullmatch(plain, at):
        try:
            row, at = parse(plain, at, path, offset, keep_payload, marks)
            rows.append(row)
        except Broken as e:
            why, at = why or str(e), marks.after(b"WARC/", at + 1)
    return rows, why


def salvage(data: bytes, path: str, keep_payload: bool = False, bomb: bool = False) -> Iterator[Row]:
    """All records of an archive in order, and a gap row for each run of bytes that yields none.

    With ``bomb`` members that unpack to over BOMB_BYTES and BOMB_RATIO times their bytes are gaps.  Records of one gzip member share its offset and length; where a part of it yields none, a gap row of the same place follows them.
    """
    at, bad, why, marks = 0, None, "", Marks(data)
    while at < len(data):
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                plain, end = inflate(data, at, bomb=bomb)
                rows, part = parse_all(plain, path, at, keep_payload)
                if not rows:
                    raise Broken(part or "empty gzip member")
                rows = [row._replace(length=end - at) for row in rows] + ([Row(path, at, end - at, "gap", part)] if part else [])
            else:
                row, end = parse(data, at, path, at, keep_payload, marks)
                rows = [row]
        except Broken as e:
            if bad is None:
                bad, why = at, str(e)
            at = min(marks.after(b"\x1f\x8b\x08", at + 1), marks.after(b"WARC/", at + 1))
            continue
        if bad is not None:
            yield Row(path, bad, at - bad, "gap", why)
            bad = None
        yield from rows
        at = end
    if bad is not None:
        yield Row(path, bad, len(data) - bad, "gap", why)


def _rows(rows: list[Row]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in RECORDS.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def write_archives(
    df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row and return the manifest (path, records, bytes) of the files that count.

    Of equal payloads of at least ``revisit_bytes`` the largest id is the response and the others
    revisit it; rows that repeat that id are responses too.  A null html is an empty payload, a
    null url has no target line, a null id is written as ``-`` and its row is a response; an empty
    table writes no file.  A payload is written whole, however long (a file then passes
    ``file_bytes`` by it); other columns are not read.  Files of tasks that failed are not in the manifest.
    """
    bounded_batches(df.sparkSession)
    whole_numbers(df, id_col)
    html = F.coalesce(df[html_col], F.lit(""))
    # Small payloads are no revisits and have no digest to meet on; copies of a large one are spread over SALT keys.
    digest = F.when(F.octet_length(html) >= revisit_bytes, F.sha1(html))
    salt = F.pmod(F.xxhash64(df[id_col], df[url_col]), F.lit(SALT)).cast("int")
    pages = df.select(df[id_col].alias("id"), df[url_col].alias("url"), html.alias("html"), digest.alias("digest"), salt.alias("salt"))
    alone = pages.where("digest is null").select("id", "url", "html", F.lit(None).cast("long").alias("first"))
    large = pages.where("digest is not null")
    groups = large.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    spread = groups.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    found = large.join(spread, ["digest", "salt"], "left").select("id", "url", "html", F.when(F.col("id") < F.col("first"), F.col("first")).cast("long").alias("first"))
    dealt = alone.union(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, name, written, records, files = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                files.append((f"{folder}/{name}", records, written))
                out = None

        for batch in batches:
            for i, url, text, first in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if out is None:
                    name, written, records = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                urn = f"urn:page:{'-' if i is None else i}"
                data = member(record(urn, url, text.encode("utf-8", "surrogatepass"), None if first is None else f"urn:page:{first}"))
                out.write(data)
                written, records = written + len(data), records + 1
                if written >= file_bytes:
                    close()
        close()
        columns = list(zip(*files, strict=True)) if files else [[], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "records", "bytes"])

    return materialize(dealt.mapInArrow(run, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records and gaps of the files that the manifest lists, each file read by one task."""
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as f:
                    data = f.read()
                yield from _batches(salvage(data, path, keep_payload))

    files = manifest.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.mapInArrow(run, RECORDS)


def read_folder(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """The records and gaps of any archives (``.warc`` or ``.warc.gz``) at a path or glob that Spark can read.

    A file is one row of Spark's reader, so it must be under 2 GB and fit a task's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _batches(salvage(data, name, keep_payload, bomb=True))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def _batches(rows: Iterator[Row], size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[Row] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _rows(held)
            held = []
    yield _rows(held)


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``df`` as archives in the shared folder and return what the reader finds, a row per record; a gap is an error."""
    manifest = write_archives(df, new_path(df.sparkSession, "warc"), id_col, url_col, html_col)
    whole = F.when(F.col("kind") == "record", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("gap in "), "path", F.lit(": "), "reason")).cast("boolean"))
    return read_archives(manifest).where(whole)
