"""Device files by ranges: a Spark data source whose tasks each read a run of blocks of a file.

``.cwa`` files are runs of 512-byte blocks.  A task reads its own run and the blocks beside it up to
the next valid one, whose anchors its samples' times need; it never reads the rest of the file.
``.gt3x`` files are compressed, so one pass per file inflates the log in pieces and hands on its
records in parts of bounded size; the parts are dealt to other tasks, which decode them.

Files are opened by URI through pyarrow's file systems, in the driver for their headers and in
tasks for their runs.
"""

from __future__ import annotations

import fnmatch
import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import devices as D

#: Bytes of a range, and of a part of a log.
RANGE_BYTES, PART_BYTES = 4 << 20, 1 << 20
BLOCK = 512
PARTS = "path string, part long, info string, kinds binary, seconds binary, ends binary, payload binary"


def files_of(path: str, suffix: str) -> list[str]:
    """URIs of the files at ``path``: a file, a folder, or a pattern in the last part of the path."""
    folder, _, last = path.rpartition("/")
    magic = any(c in last for c in "*?[")
    store, place = pafs.FileSystem.from_uri(folder if magic else path)
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    # The part of the URI before the file system's own path (a host, or nothing).
    lead = path[: path.index(place)] if place in path else scheme
    info = store.get_file_info(place)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f.path for f in store.get_file_info(pafs.FileSelector(place)) if f.type == pafs.FileType.File]
    found = [f for f in found if fnmatch.fnmatch(f.rsplit("/", 1)[-1], last) or not magic]
    return sorted(lead + f for f in found if f.lower().endswith(suffix))


def read_at(uri: str, start: int, stop: int | None = None) -> bytes:
    store, place = pafs.FileSystem.from_uri(uri)
    with store.open_input_file(place) as f:
        size = f.size()
        stop = size if stop is None else min(stop, size)
        return f.read_at(max(stop - start, 0), start)


@dataclass
class BlockRange(InputPartition):
    """Blocks ``first`` to ``last`` (not included) of the ``blocks`` of a file whose data begin at ``data_at``."""

    uri: str
    data_at: int
    first: int
    last: int
    blocks: int
    lead: bytes


class CwaReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, extras: bool):
        self.path, self.range_blocks, self.extras = path, max(1, range_bytes // BLOCK), extras

    def partitions(self) -> list[BlockRange]:
        out = []
        for uri in files_of(self.path, ".cwa"):
            store, place = pafs.FileSystem.from_uri(uri)
            with store.open_input_file(place) as f:
                size, head = f.size(), D.cwa_header(f.read_at(BLOCK, 0))
                data_at = head["data_at"] if head else 0
                n, lead, at = max(size - data_at, 0) // BLOCK, b"", 0
                while at < n and not lead:  # the first valid block tells axes and rate
                    raw = f.read_at(64 * BLOCK, data_at + at * BLOCK)
                    good = np.flatnonzero(D.cwa_blocks(raw)[1])
                    lead = raw[good[0] * BLOCK : (good[0] + 1) * BLOCK] if len(good) else b""
                    at += 64
            if lead:
                out += [BlockRange(uri, data_at, a, min(a + self.range_blocks, n), n, lead) for a in range(0, n, self.range_blocks)]
        return out or [BlockRange("", 0, 0, 0, 0, b"")]

    def read(self, partition: BlockRange) -> Iterator[pa.RecordBatch]:
        if not partition.lead:
            return
        yield cwa_range(partition, self.extras)


def cwa_range(p: BlockRange, extras: bool = False) -> pa.RecordBatch:
    """The samples of a range's blocks."""
    lead = np.frombuffer(p.lead, dtype=D.CWA_BLOCK)[0]

    def valid(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        blocks, ok = D.cwa_blocks(read_at(p.uri, p.data_at + first * BLOCK, p.data_at + last * BLOCK))
        return blocks, ok & (blocks["axes_bps"] == lead["axes_bps"]) & (blocks["rate"] == lead["rate"])

    def beside(step: int) -> np.ndarray:
        """The nearest valid block before (-1) or after (1) the range."""
        at = p.first - 1 if step < 0 else p.last
        while 0 <= at < p.blocks:
            block, ok = valid(at, at + 1)
            if ok[0]:
                return block
            at += step
        return np.zeros(0, D.CWA_BLOCK)

    own, ok = valid(p.first, p.last)
    own = own[ok]
    if len(own):
        early, late = beside(-1), beside(1)
        near = np.concatenate([early, own, late])
        mine = np.repeat([False, True, False], [len(early), len(own), len(late)])
        us, xyz, more = D.cwa_samples(near, mine, lead)
    else:
        us, xyz, more = np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros((0, 2))
    columns = {"path": pa.array([p.uri] * len(us), pa.string()), "time": pa.array(us).cast(pa.timestamp("us"))} | {a: pa.array(np.ascontiguousarray(xyz[:, i])) for i, a in enumerate("xyz")}
    if extras:
        columns |= {c: pa.array(np.ascontiguousarray(more[:, i])) for i, c in enumerate(("light", "temperature"))}
    return pa.RecordBatch.from_pydict(columns)


@dataclass
class WholeFile(InputPartition):
    uri: str


class LogReader(DataSourceReader):
    """One partition a file, as its log can only be inflated from the start; parts of bounded size come out."""

    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[WholeFile]:
        return [WholeFile(u) for u in files_of(self.path, ".gt3x")] or [WholeFile("")]

    def read(self, partition: WholeFile) -> Iterator[pa.RecordBatch]:
        if partition.uri:
            yield from log_parts(partition.uri, self.part_bytes)


def streamed_records(stream, step: int = 1 << 18) -> Iterator[tuple[int, int, bytes]]:
    """(type, second, payload) of the records of a log read piece by piece, as :func:`.devices.gt3x_records` finds them in a whole one."""
    held, end = b"", False
    while not end:
        piece = stream.read(step)
        held, end = held + piece, not piece
        at = 0
        while at + 9 <= len(held):
            mark, _, _, size = struct.unpack_from("<BBIH", held, at)
            whole = at + 9 + size
            if mark == 0x1E and whole > len(held) and not end:
                break  # the record's rest is still to come
            found = next(D.gt3x_records(held[at:whole]), None) if mark == 0x1E and whole <= len(held) else None
            # A record must begin here: later ones are found when their own place is reached.
            if found is not None and len(found[2]) == size:
                yield found
                at = whole
            else:
                at += 1
        held = held[at:]


def log_parts(uri: str, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """A file's activity records in parts of about ``part_bytes``."""
    store, place = pafs.FileSystem.from_uri(uri)
    with store.open_input_file(place) as f, zipfile.ZipFile(f) as z:
        names = set(z.namelist())
        if "log.bin" not in names:
            raise ValueError(f"{uri}: no record log; the old format isn't read")
        info = D.gt3x_info(z.read("info.txt").decode("utf-8-sig"))
        own = json.loads(z.read("calibration.json")) if "calibration.json" in names else {}
        rate = D._number(info.get("Sample Rate"))
        about, part, held, size = json.dumps({"info": info, "own": own}), 0, [], 0

        def batch() -> pa.RecordBatch:
            kinds, seconds, payloads = zip(*held, strict=True)
            ends = np.cumsum([len(x) for x in payloads], dtype="<i8")
            row = [uri, part, about, bytes(kinds), np.array(seconds, "<i8").tobytes(), ends.tobytes(), b"".join(payloads)]
            types = [pa.string(), pa.int64(), pa.string(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in PARTS.split(", ")])

        any_record = False
        with z.open("log.bin") as log:
            for record in D.gt3x_activity(streamed_records(log), uri, rate):
                any_record = True
                held.append(record)
                size += len(record[2])
                if size >= part_bytes:
                    yield batch()
                    part, held, size = part + 1, [], 0
        if held:
            yield batch()
        if not any_record:
            raise ValueError(f"{uri}: no activity records")


class CwaSource(DataSource):
    """``spark.read.format("cwa_ranges")``: options path, rangeBytes, extras (light and temperature columns)."""

    @classmethod
    def name(cls) -> str:
        return "cwa_ranges"

    def _extras(self) -> bool:
        return self.options.get("extras", "false").lower() == "true"

    def schema(self) -> str:
        return D.SERIES + (", light double, temperature double" if self._extras() else "")

    def reader(self, schema) -> CwaReader:
        return CwaReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)), self._extras())


class LogSource(DataSource):
    """``spark.read.format("gt3x_parts")``: options path, partBytes."""

    @classmethod
    def name(cls) -> str:
        return "gt3x_parts"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)))


def read_cwa(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, extras: bool = False) -> DataFrame:
    """Samples of ``.cwa`` files, a task for each ``range_bytes`` of a file.

    The result is that of the file read at once.  Blocks with a wrong mark, length, checksum, axes
    or rate are left out; a file without a valid block, or cut short, gives the rows that it has;
    light and temperature are interpolated between blocks.
    """
    spark.dataSource.register(CwaSource)
    return spark.read.format("cwa_ranges").options(path=path, rangeBytes=str(range_bytes), extras=str(extras)).load()


def read_gt3x(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Samples in g of ``.gt3x`` files: inflated file by file, decoded and calibrated in parts by all tasks.

    Idle-sleep recordings, the old format, mixed activity types, and records that are no second
    long are refused by an error that names the file; broken records are skipped.
    """
    spark.dataSource.register(LogSource)
    parts = spark.read.format("gt3x_parts").options(path=path, partBytes=str(part_bytes)).load()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                about = json.loads(r.info)
                seconds, ends = np.frombuffer(r.seconds, "<i8").tolist(), np.frombuffer(r.ends, "<i8").tolist()
                payloads = [bytes(r.payload[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                records = list(zip(bytes(r.kinds), seconds, payloads, strict=True))
                rate = D._number(about["info"].get("Sample Rate")) or 30.0
                calibration = D.gt3x_calibration(about["own"], rate, D.gt3x_scale(about["info"], records[0][0]))
                yield D._frame(r.path, *D.gt3x_samples(records, rate, *calibration))

    return parts.repartition("path", "part").mapInPandas(run, D.SERIES)


def cwa_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, device, session, rate, start, stop, note, data_at) of ``.cwa`` files; a task reads one block of a file."""
    files = spark.createDataFrame([(u,) for u in files_of(path, ".cwa")], "path string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = [D.cwa_header(read_at(u, 0, BLOCK)) for u in pdf["path"]]
            names = ["device", "session", "rate", "start", "stop", "note", "data_at"]
            yield pd.DataFrame({"path": pdf["path"]} | {n: [h.get(n) for h in heads] for n in names}).astype({"device": "Int64", "session": "Int64", "data_at": "Int64", "rate": float})

    found = files.mapInPandas(run, "path string, device long, session long, rate double, start string, stop string, note string, data_at long")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


def trim_to_start(samples: DataFrame, headers: DataFrame, days: float = 8, key: str = "path") -> DataFrame:
    """Samples of recordings that span over ``days`` from their header's start on; others, and those without a start, are kept whole."""
    span = samples.groupBy(key).agg(F.min("time").alias("low"), F.max("time").alias("high"))
    long = F.timestamp_diff("SECOND", F.col("low"), F.col("high")) > days * 86400
    bound = span.join(headers.select(key, F.col("start").alias("begin")), key).where(long & F.col("begin").isNotNull()).select(F.col(key).alias("of"), "begin")
    return samples.join(bound, samples[key] == F.col("of"), "left").where(F.col("begin").isNull() | (F.col("time") >= F.col("begin"))).select(samples["*"])
