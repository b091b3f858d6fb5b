"""Readers of accelerometer files as tables: ``.cwa``, ``.bin``, ``.gt3x`` and CSV.

Files come through Spark's own readers (``binaryFile``, ``text``, ``csv``), so any store that Spark
opens works; decoding is array work inside a task, a file or a run of pages at a time.  Every reader
returns (path, time, x, y, z) with the time as a timestamp without zone.
"""

from __future__ import annotations

import csv
import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce
from urllib.parse import unquote_plus

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = "path string, time timestamp_ntz, x double, y double, z double"
EPOCH = np.datetime64("1970-01-01T00:00:00", "us")


def _frame(path: str, us: np.ndarray, xyz: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "time": EPOCH + us.astype("timedelta64[us]"), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})


# --- .cwa: 512-byte blocks ------------------------------------------------------------------

#: A data block: header "AX", packed time, rate code, axes and packing, and 480 bytes of samples.
CWA_BLOCK = np.dtype({
    "names": ["header", "length", "fraction", "session", "sequence", "time", "light", "temperature", "events", "battery", "rate", "axes_bps", "offset", "count", "data", "checksum"],
    "formats": ["<u2", "<u2", "<u2", "<u4", "<u4", "<u4", "<u2", "<u2", "u1", "u1", "u1", "u1", "<i2", "<u2", "V480", "<u2"],
    "offsets": [0, 2, 4, 6, 10, 14, 18, 20, 22, 23, 24, 25, 26, 28, 30, 510],
    "itemsize": 512,
})


def unpack_time(packed: Column) -> Column:
    """Packed time (6 bits of year since 2000, 4 month, 5 day, 5 hour, 6 minute, 6 second) as a timestamp without zone."""
    bits = lambda at, n: F.shiftrightunsigned(packed, at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    return F.make_timestamp_ntz(bits(26, 6) + 2000, bits(22, 4), bits(17, 5), bits(12, 5), bits(6, 6), bits(0, 6).cast("decimal(8,6)"))


def _cwa_seconds(packed: np.ndarray) -> np.ndarray:
    p = packed.astype(np.int64)
    year, month, day = (p >> 26) + 2000, (p >> 22) & 15, (p >> 17) & 31
    ok = (month >= 1) & (month <= 12) & (day >= 1)
    months = (year - 1970) * 12 + np.where(ok, month, 1) - 1
    days = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + np.where(ok, day, 1) - 1
    return days * 86400 + ((p >> 12) & 31) * 3600 + ((p >> 6) & 63) * 60 + (p & 63)


def cwa_rate(code: int) -> float:
    return 3200 / (1 << (15 - (code & 15)))


def cwa_header(content: bytes) -> dict:
    """Device, session, rate, logging window, annotations and the first data block's place; empty if it isn't a header block."""
    if content[:2] != b"MD" or len(content) < 512:
        return {}
    size, device, session, upper = struct.unpack_from("<H", content, 2)[0], *struct.unpack_from("<HIH", content, 5)
    # The upper half of the device's number; unset in old files.
    device += 0 if upper == 0xFFFF else upper << 16
    start, stop = struct.unpack_from("<II", content, 13)
    note = unquote_plus(content[64:512].rstrip(b"\x00\x20\xff").decode("latin-1"))
    iso = lambda p: (datetime(1970, 1, 1) + timedelta(seconds=int(_cwa_seconds(np.array([p]))[0]))).isoformat() if p not in (0, 0xFFFFFFFF) else None
    # The packet's length is told without its first four bytes; data begin at the next whole block.
    data_at = -(-(size or 1020) // 512) * 512
    return {"device": device, "session": session, "rate": cwa_rate(content[36]), "range": 16 >> (content[36] >> 6), "start": iso(start), "stop": iso(stop), "note": note, "data_at": data_at}


def cwa_blocks(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Whole blocks of ``raw`` and which of them have the right mark, length and checksum."""
    raw = raw[: len(raw) // 512 * 512]
    blocks = np.frombuffer(raw, dtype=CWA_BLOCK)
    sums = np.frombuffer(raw, dtype="<u2").reshape(-1, 256).sum(1, dtype=np.uint32) & 0xFFFF
    return blocks, (blocks["header"] == 0x5841) & (blocks["length"] == 508) & (sums == 0)


def cwa_samples(blocks: np.ndarray, own: np.ndarray, lead: np.void) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(microseconds, axes in g, (light, temperature)) of the samples of the valid blocks marked ``own``.

    Times run evenly between the anchors of the valid ``blocks``, so the blocks beside the own ones
    give theirs; before the first and after the last anchor of all they go on at the rate.  ``lead`` is
    the file's first valid block: axes and rate are its own.
    """
    if not own.any():
        return np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros((0, 2))
    rate, axes, packed = cwa_rate(int(lead["rate"])), int(lead["axes_bps"]) >> 4, int(lead["axes_bps"]) & 15 == 0
    unit = float(1 << (8 + (int(lead["light"]) >> 13 & 7))) if int(lead["light"]) >> 13 & 7 else 256.0
    fraction = np.where(blocks["fraction"] & 0x8000, (blocks["fraction"] & 0x7FFF) / 32768.0, 0.0)
    whole, counts = _cwa_seconds(blocks["time"]), blocks["count"].astype(np.int64)
    before = np.cumsum(counts) - counts
    # An anchor is the time of the block's sample at its offset; a sample counts from the anchor before it, so that a
    # range's times have the digits of the whole file's.
    place = before + blocks["offset"]
    index = np.arange(int(counts.sum()))
    k = np.clip(np.searchsorted(place, index, side="right") - 1, 0, len(place) - 1)
    step = np.append(np.diff(whole) + np.diff(fraction), 0.0) / np.append(np.maximum(np.diff(place), 1), 1)
    step[-1] = 1 / rate
    each = np.where(index < place[0], 1 / rate, step[k])
    us = whole[k] * 1_000_000 + np.rint((fraction[k] + (index - place[k]) * each) * 1e6).astype(np.int64)
    light, warmth = (blocks["light"] & 0x3FF).astype(float), (blocks["temperature"] & 0x3FF) * (75.0 / 256) - 50
    extras = np.stack([np.interp(index, place, light), np.interp(index, place, warmth)], axis=1)
    raw = np.ascontiguousarray(blocks["data"]).view(np.uint8).reshape(len(blocks), 480)
    if packed:
        words = raw.view("<u4").astype(np.int64)
        exponent = words >> 30
        xyz = np.stack([(((words >> s) & 1023) ^ 512) - 512 for s in (0, 10, 20)], axis=2) << exponent[:, :, None]
    else:
        values = raw.view("<i2")
        per = 240 // axes
        xyz = values[:, : per * axes].reshape(len(blocks), per, axes)[:, :, axes - 3 :].astype(np.int64)
    held = np.arange(xyz.shape[1])[None, :] < counts[:, None]
    mine = np.repeat(own, counts)
    return us[mine], xyz[held & own[:, None]] / unit, extras[mine]


def decode_cwa(path: str, content: bytes) -> pd.DataFrame:
    """Samples of the valid blocks: right marks, lengths, axes, rate and checksum; times run evenly between blocks' anchors."""
    head = cwa_header(content)
    blocks, valid = cwa_blocks(content[head["data_at"] if head else 0 :])
    if not valid.any():
        return _frame(path, np.zeros(0, np.int64), np.zeros((0, 3)))
    blocks = blocks[valid]
    lead = blocks[0]
    blocks = blocks[(blocks["axes_bps"] == lead["axes_bps"]) & (blocks["rate"] == lead["rate"])]
    us, xyz, _ = cwa_samples(blocks, np.ones(len(blocks), bool), lead)
    return _frame(path, us, xyz)


# --- .bin: text pages of hexadecimal samples ---------------------------------------------------

def read_geneactiv(spark: SparkSession, path: str, extras: bool = False) -> DataFrame:
    """Pages as rows of the text reader and samples by SQL: 12 hex digits each, three 12-bit axes, 10 bits of light and a button.

    The header's gain and offset are a row for each file; time is the page's plus sample over rate.
    A file whose pages are not as many as its header says is an error when its rows are computed; a
    header that doesn't say is not held to anything.  ``extras`` adds light (lux) and button.
    """
    pages = spark.read.option("lineSep", "Recorded Data").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("value"))
    field = lambda name: F.regexp_extract("value", rf"(?m)^\s*{name}\s*:\s*(-?[0-9.]+)", 1).try_cast("double")
    head = pages.where(F.col("value").contains("x gain")).select(
        "path", *[field(f"{a} {n}").alias(f"{n}_{a}") for a in "xyz" for n in ("gain", "offset")], field("Number of Pages").alias("stated"), field("Volts").alias("volts"), field("Lux").alias("lux")
    )
    body = pages.where(F.col("value").contains("Sequence Number")).select(
        "path", field("Sequence Number").cast("long").alias("page"), F.regexp_extract("value", r"Page Time:([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}:[0-9]{3})", 1).alias("at"),
        field("Measurement Frequency").alias("fs"), F.regexp_extract("value", r"(?m)^([0-9A-Fa-f]{12,})\s*$", 1).alias("hex"),
    )
    found = body.groupBy("path").agg(F.count(F.lit(1)).alias("found"))
    short = F.when(F.col("found") == F.col("stated"), F.col("gain_x")).otherwise(
        F.raise_error(F.concat("path", F.lit(": "), F.col("found").cast("string"), F.lit(" pages, the header says "), F.col("stated").cast("string"))).cast("double")
    )
    head = head.join(found, "path").withColumn("gain_x", F.when(F.col("stated").isNull(), F.col("gain_x")).otherwise(short)).drop("stated", "found")
    # A row for each file; Spark broadcasts it if it measures small enough.
    return hex_samples(body.where(F.length("hex") % 12 == 0).join(head, "path"), extras)


def twelve_bits(digits: Column) -> Column:
    """Three hex digits as a signed 12-bit number."""
    v = F.conv(digits, 16, 10).cast("int")
    return F.when(v >= 2048, v - 4096).otherwise(v)


def hex_samples(pages: DataFrame, extras: bool = False) -> DataFrame:
    """Samples of (path, page, at, fs, hex, gain_*, offset_*) rows, by built-in functions alone; ``extras`` need volts and lux too."""
    rows = pages.where("length(hex) >= 12").withColumn("i", F.explode(F.sequence(F.lit(0), (F.length("hex") / 12).cast("int") - 1)))
    start = F.concat(F.substring("at", 1, 19), F.lit("."), F.substring("at", 21, 3)).cast("timestamp_ntz")
    time = F.timestamp_add("MICROSECOND", F.round(F.col("i") / F.col("fs") * 1_000_000).cast("long"), start)
    axis = lambda k, a: ((twelve_bits(F.col("hex").substr(F.col("i") * 12 + 1 + 3 * k, F.lit(3))) * 100 - F.col(f"offset_{a}")) / F.col(f"gain_{a}")).alias(a)
    last = F.conv(F.col("hex").substr(F.col("i") * 12 + 10, F.lit(3)), 16, 10).cast("int")
    more = [(F.shiftright(last, 2) * F.col("lux") / F.col("volts")).alias("light"), F.shiftright(last, 1).bitwiseAND(F.lit(1)).alias("button")] if extras else []
    return rows.select("path", time.alias("time"), axis(0, "x"), axis(1, "y"), axis(2, "z"), *more)


# --- .gt3x: a zip of records ---------------------------------------------------------------------

# Record types that hold samples.
ACTIVITY, PARAMETERS, ACTIVITY2 = 0x00, 0x15, 0x1A


def checksum(data: bytes) -> int:
    """One's complement of the exclusive or of all bytes."""
    return ~int(np.bitwise_xor.reduce(np.frombuffer(data, np.uint8), initial=0)) & 0xFF


def gt3x_records(log: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(type, second, payload) of the records whose checksum holds; others are skipped."""
    at = 0
    while at + 9 <= len(log):
        mark, kind, second, size = struct.unpack_from("<BBIH", log, at)
        end = at + 8 + size
        if mark != 0x1E or end >= len(log):
            at += 1
            continue
        if checksum(log[at:end]) == log[end]:
            yield kind, second, log[at + 8 : end]
            at = end + 1
        else:
            at += 1


def twelve_bit_triples(payload: bytes) -> np.ndarray:
    """Packed 12-bit values in y, x, z order as x, y, z rows."""
    bits = np.frombuffer(payload[: len(payload) // 9 * 9 + (4.5 <= len(payload) % 9) * 5], np.uint8)
    nibbles = np.stack([bits >> 4, bits & 15], axis=1).reshape(-1).astype(np.int32)
    n = len(nibbles) // 9 * 3
    v = nibbles[: n * 3].reshape(-1, 3) @ np.array([256, 16, 1])
    return np.where(v >= 2048, v - 4096, v).reshape(-1, 3)[:, [1, 0, 2]]


def gt3x_info(text: str) -> dict[str, str]:
    """Names and values of a recording's info file."""
    pairs = (line.partition(":") for line in text.lstrip("\ufeff").splitlines())
    return {name.strip(): value.strip() for name, colon, value in pairs if colon}


def _number(said: str | None) -> float | None:
    try:
        return float(said.replace(",", "."))
    except (AttributeError, ValueError):
        return None


def gt3x_scale(info: dict[str, str], kind: int) -> float:
    """Counts a g: the header's own scale, else the type's range of counts over the header's range of g, else 256."""
    scale, low, high = (_number(info.get(f"Acceleration {n}")) for n in ("Scale", "Min", "Max"))
    if scale:
        return scale
    return 2.0 ** (12 if kind == ACTIVITY else 16) / (high - low) if low is not None and high is not None and high > low else 256.0


def gt3x_calibration(own: dict, rate: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, offset) such that g = matrix @ (counts - offset), from the maker's calibration.

    Data that are calibrated already, and calibrations that lack a coefficient, only have the scale.
    """
    plain = np.eye(3) / scale, np.zeros(3)
    if not own or own.get("isCalibrated", True):
        return plain
    method = own.get("calibrationMethod")
    if method not in (1, 2):
        raise ValueError(f"calibration method {method} is unknown")
    try:
        if method == 1:
            high, low, zero = (np.array([own[f"{n}ZeroGOffset{a}" if n else f"zeroGOffset{a}"] for a in "XYZ"], float) for n in ("positive", "negative", ""))
            gain = 2 / (high - low)
            return np.diag(gain), zero * gain
        coefficient = lambda name: float(own[f"{name}_{int(rate)}"])
        matrix = np.diag([100 / coefficient(f"sensitivity{a}{a}") for a in "XYZ"])
        for i, j in ((0, 1), (0, 2), (1, 2)):
            matrix[i, j] = matrix[j, i] = 1 / (250 + coefficient("sensitivity" + "XYZ"[i] + "XYZ"[j]) / 100) - 1 / 250
        return matrix, np.array([coefficient(f"offset{a}") for a in "XYZ"])
    except KeyError:
        return plain


def gt3x_activity(records: Iterator[tuple[int, int, bytes]], path: str, rate: float | None = None) -> Iterator[tuple[int, int, bytes]]:
    """The activity records; refuses idle sleep, several types, none at all, and (with ``rate``) records that are no second long."""
    types: set[int] = set()
    for kind, second, payload in records:
        if kind == PARAMETERS and any(struct.unpack_from("<HHI", payload, k)[:2] == (1, 0x9) and payload[k + 4] & 1 for k in range(0, len(payload) // 8 * 8, 8)):
            raise ValueError(f"{path}: recorded with idle sleep mode on")
        # Payloads of one byte are left by a docked device.
        if kind not in (ACTIVITY, ACTIVITY2) or len(payload) < 2:
            continue
        types.add(kind)
        if len(types) > 1:
            raise ValueError(f"{path}: records of several activity types")
        n = len(gt3x_counts(kind, payload)) if rate else 0
        if rate and n != rate:
            raise ValueError(f"{path}: {n} samples in a record of a second, {rate:g} expected")
        yield kind, second, payload


def gt3x_counts(kind: int, payload: bytes) -> np.ndarray:
    """Rows of x, y, z counts of an activity record."""
    return twelve_bit_triples(payload) if kind == ACTIVITY else np.frombuffer(payload[: len(payload) // 6 * 6], "<i2").reshape(-1, 3).astype(np.int32)


def gt3x_samples(records: list[tuple[int, int, bytes]], rate: float, matrix: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds, axes in g) of activity records."""
    counts = [gt3x_counts(kind, payload) for kind, _, payload in records]
    if not counts:
        return np.zeros(0, np.int64), np.zeros((0, 3))
    us = [second * 1_000_000 + np.rint(np.arange(len(c)) / rate * 1e6).astype(np.int64) for (_, second, _), c in zip(records, counts, strict=True)]
    return np.concatenate(us), (np.concatenate(counts) - offset) @ matrix.T


def decode_gt3x(path: str, content: bytes) -> pd.DataFrame:
    """Samples in g of a whole file; idle-sleep recordings, the old format and mixed activity types are refused."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "log.bin" not in names:
            raise ValueError(f"{path}: no record log; the old format isn't read")
        info = gt3x_info(z.read("info.txt").decode("utf-8-sig"))
        records = list(gt3x_activity(gt3x_records(z.read("log.bin")), path))
        own = json.loads(z.read("calibration.json")) if "calibration.json" in names else {}
    rate = _number(info.get("Sample Rate")) or 30.0
    calibration = gt3x_calibration(own, rate, gt3x_scale(info, records[0][0] if records else ACTIVITY))
    return _frame(path, *gt3x_samples(records, rate, *calibration))


# --- generic CSV ---------------------------------------------------------------------------------

# Names under which the columns are accepted.
ALIASES = {
    "time": ("time", "timestamp", "datetime", "date"),
    "x": ("x", "acc_x", "ax", "accel_x", "a_x"),
    "y": ("y", "acc_y", "ay", "accel_y", "a_y"),
    "z": ("z", "acc_z", "az", "accel_z", "a_z"),
}


def detect_delimiter(sample: str, possible: str = ",;\t|", fallback: str = ";") -> str:
    """The separator whose count a line is the same on all lines, else the one with the most and steadiest; of a bounded sample."""
    lines = [s for s in sample.splitlines() if s.strip()]
    lines = lines[:-1] if len(lines) > 1 and not sample.endswith("\n") else lines
    if not lines:
        return fallback
    try:
        guess = csv.Sniffer().sniff(sample, possible).delimiter
        if len({s.count(guess) for s in lines}) == 1 and lines[0].count(guess):
            return guess
    except csv.Error:
        pass
    counts = {d: np.array([s.count(d) for s in lines], float) for d in possible}
    best = max(possible, key=lambda d: counts[d].mean() - counts[d].var())
    return best if counts[best].mean() > 0 else fallback


#: Bytes of a file from which its separator and header are told.
HEAD_BYTES = 1 << 16


def _heads(spark: SparkSession, path: str) -> dict[str, str]:
    """Each file's first lines; files are listed by Spark's own reader, and a bounded head of each is read."""
    names = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    out = {}
    for name in names:
        if name.rsplit(".", 1)[-1] in ("gz", "bz2", "zst", "lz4", "snappy", "deflate"):
            out[name] = "\n".join(r.value for r in spark.read.text(name).limit(100).collect())
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
        try:
            data = bytes(stream.readNBytes(HEAD_BYTES))
        finally:
            stream.close()
        lines = data.decode("utf-8", "replace").lstrip("\ufeff").splitlines()
        out[name] = "\n".join((lines[:-1] if len(data) == HEAD_BYTES and len(lines) > 1 else lines)[:100])
    return out


def csv_layout(path: str, head: str) -> tuple[str, bool, int, tuple[int, ...]]:
    """(separator, with header, columns, places of time, x, y, z) of a file that starts with the lines ``head``."""
    sep = detect_delimiter(head + "\n")
    first = next(csv.reader([head.split("\n", 1)[0]], delimiter=sep), [])
    names = [n.strip().lower() for n in first]
    found = {c: next((names.index(a) for a in alias if a in names), None) for c, alias in ALIASES.items()}
    titled = all(v is not None for v in found.values())
    if any(v is not None for v in found.values()) and not titled:
        raise ValueError(f"{path}: header lacks {sorted(c for c, v in found.items() if v is None)}")
    return sep, titled, len(first), tuple(found.values()) if titled else tuple(range(4))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with headers of known names, or without: time, x, y, z first; values that don't parse are errors.

    Each file's own header places its columns; files of one layout are read together.
    """
    layouts: dict[tuple, list[str]] = {}
    for name, head in _heads(spark, path).items():
        layouts.setdefault(csv_layout(name, head), []).append(name)
    if not layouts:
        raise ValueError(f"no files at {path}")
    parts = [_csv_files(spark, files, *layout) for layout, files in sorted(layouts.items())]
    return reduce(DataFrame.union, parts)


def _csv_files(spark: SparkSession, files: list[str], sep: str, titled: bool, columns: int, place: tuple[int, ...]) -> DataFrame:
    schema = ", ".join(f"c{i} string" for i in range(columns))
    rows = spark.read.csv(files, schema=schema, sep=sep, header=titled, enforceSchema=True, mode="FAILFAST")
    time, *axes = (F.trim(F.col(f"c{i}")) for i in place)
    return rows.select(F.col("_metadata.file_path").alias("path"), time.cast("timestamp_ntz").alias("time"), *[a.cast("double").alias(n) for a, n in zip(axes, "xyz", strict=True)])


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the extension; ``.cwa`` files are read by ranges and ``.gt3x`` logs in parts, see :mod:`.ranges`."""
    from . import ranges

    kind = re.sub(r".*\.", "", path.rstrip("*/").lower())
    readers = {"csv": read_csv, "bin": read_geneactiv, "cwa": ranges.read_cwa, "gt3x": ranges.read_gt3x}
    if kind not in readers:
        raise ValueError(f"no reader for .{kind} files")
    return readers[kind](spark, path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, header as JSON) of ``.cwa`` files."""
    from . import ranges

    return ranges.cwa_headers(spark, path).select("path", F.to_json(F.struct("device", "session", "rate", "start", "stop", "note", "data_at")).alias("header"))
