"""Device files read by ranges and parts give the rows of the whole file."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import devices as D
from tidemark.sources import ranges as R

from .test_sources import cwa_block, cwa_time, gt3x


def recording(n, broken=(), rate=0x4A):
    """A header and ``n`` blocks of 1 s whose anchors lie inside the block and whose clocks have fractions; some are broken."""
    rng = np.random.default_rng(7)
    head = bytearray(1024)
    head[:2], head[36] = b"MD", rate
    struct.pack_into("<H", head, 2, 1020)
    struct.pack_into("<HIH", head, 5, 77, 9, 0)
    struct.pack_into("<I", head, 13, cwa_time(2024, 5, 1, 0, 0, 20))
    out = [bytes(head)]
    for i in range(n):
        b = bytearray(cwa_block(cwa_time(2024, 5, 1, 0, i // 60, i % 60), rng.integers(-999, 999, (int(rng.integers(70, 81)), 3)), rate=rate))
        struct.pack_into("<H", b, 4, 0x8000 | int(rng.integers(0, 1 << 15)))
        struct.pack_into("<h", b, 26, int(rng.integers(0, 40)))
        struct.pack_into("<HH", b, 18, int(rng.integers(0, 1 << 10)), int(rng.integers(0, 1 << 10)))
        struct.pack_into("<H", b, 510, 0)
        struct.pack_into("<H", b, 510, -int(np.frombuffer(bytes(b), "<u2").sum(dtype=np.uint32)) & 0xFFFF)
        if i in broken:
            b[100] ^= 1
        out.append(bytes(b))
    return b"".join(out)


def columns(df):
    return [tuple(r) for r in df.orderBy("time").collect()]


@pytest.mark.parametrize("blocks", [1, 2, 5, 7, 100])
def test_ranges_give_the_rows_of_the_whole_file(spark, tmp_path, blocks):
    # Broken blocks stand alone, in rows, at ranges' edges, and fill a range of two.
    data = recording(23, broken={0, 5, 6, 7, 8, 9, 14, 22})
    (tmp_path / "a.cwa").write_bytes(data + b"cut")
    whole = D.decode_cwa("a", data)
    out = R.read_cwa(spark, f"file://{tmp_path}/a.cwa", range_bytes=blocks * 512)
    assert out.rdd.getNumPartitions() == -(-23 // blocks)
    got = columns(out)
    assert [r[1] for r in got] == [t.to_pydatetime() for t in whole["time"]]
    assert [r[2:] for r in got] == [tuple(v) for v in whole[["x", "y", "z"]].to_numpy()]


def test_a_task_reads_its_range_and_the_blocks_beside_it(tmp_path, monkeypatch):
    (tmp_path / "a.cwa").write_bytes(recording(30, broken={10}))
    reader = R.CwaReader(f"file://{tmp_path}/a.cwa", 5 * 512, False)
    read, real = [], R.read_at
    monkeypatch.setattr(R, "read_at", lambda uri, a, b=None: read.append((a, b)) or real(uri, a, b))
    for p in reader.partitions():
        read.clear()
        assert sum(b.num_rows for b in reader.read(p)) > 0
        # The broken block lies beside the second range, which looks one further.
        assert sum(b - a for a, b in read) <= (5 + 2 + (p.last == 10)) * 512
        assert min(a for a, _ in read) >= 1024 + (p.first - 1 if p.first else 0) * 512


def test_light_and_temperature_do_not_depend_on_ranges(spark, tmp_path):
    (tmp_path / "a.cwa").write_bytes(recording(9, broken={4}))
    path = f"file://{tmp_path}/a.cwa"
    a, b = (columns(R.read_cwa(spark, path, n * 512, extras=True)) for n in (2, 100))
    assert a == b and len({r[5] for r in a}) > 5 and all(-50 <= r[6] < 250 for r in a)


def test_folders_patterns_empty_files_and_headers(spark, tmp_path):
    (tmp_path / "a.cwa").write_bytes(recording(4))
    (tmp_path / "b.cwa").write_bytes(recording(3))
    (tmp_path / "empty.cwa").write_bytes(b"")
    (tmp_path / "noise.cwa").write_bytes(b"MD" + b"\x00" * 5000)
    (tmp_path / "c.txt").write_bytes(b"x")
    for path in (f"file://{tmp_path}", f"file://{tmp_path}/*.cwa"):
        out = R.read_cwa(spark, path, 1024).groupBy("path").count().collect()
        assert sorted(r.path.rsplit("/", 1)[-1] for r in out) == ["a.cwa", "b.cwa"]
    assert R.read_cwa(spark, f"file://{tmp_path}/empty.cwa").count() == 0
    with pytest.raises(Exception, match="nothing"):
        R.read_cwa(spark, f"file://{tmp_path}/nothing.cwa").count()
    heads = {r.path.rsplit("/", 1)[-1]: r for r in R.cwa_headers(spark, f"file://{tmp_path}").collect()}
    assert heads["a.cwa"].device == 77 and heads["a.cwa"].data_at == 1024 and str(heads["a.cwa"].start) == "2024-05-01 00:00:20" and heads["empty.cwa"].device is None


def test_data_begin_where_the_header_says(spark, tmp_path):
    data = bytearray(recording(3))
    struct.pack_into("<H", data, 2, 2044)
    (tmp_path / "a.cwa").write_bytes(bytes(data[:1024]) + b"\x00" * 1024 + bytes(data[1024:]))
    assert R.read_cwa(spark, f"file://{tmp_path}/a.cwa").count() == len(D.decode_cwa("a", recording(3)))


def test_long_recordings_begin_at_the_header_s_start(spark, tmp_path):
    (tmp_path / "a.cwa").write_bytes(recording(40))
    path = f"file://{tmp_path}"
    rows, heads = R.read_cwa(spark, path), R.cwa_headers(spark, path)
    assert R.trim_to_start(rows, heads).count() == rows.count()
    cut = R.trim_to_start(rows, heads, days=30 / 86400)
    assert 0 < cut.count() < rows.count() and cut.agg(F.min("time")).first()[0].second == 20
    assert R.trim_to_start(rows, heads.withColumn("start", F.lit(None).cast("timestamp_ntz")), days=0).count() == rows.count()


def log(n, rate=2, kind=0x1A):
    rng = np.random.default_rng(1)
    if kind == 0x1A:
        return [(kind, 100 + i, rng.integers(-3000, 3000, 3 * rate).astype("<i2").tobytes()) for i in range(n)]
    return [(kind, 100 + i, rng.integers(0, 256, rate * 9 // 2, dtype=np.uint8).tobytes()) for i in range(n)]


@pytest.mark.parametrize("kind", [0x1A, 0x00])
def test_parts_of_a_log_give_the_rows_of_the_whole_file(spark, tmp_path, kind):
    data = gt3x([(0x02, 5, b"battery"), *log(200, kind=kind), (kind, 400, b"\x01")])
    (tmp_path / "a.gt3x").write_bytes(data)
    whole = D.decode_gt3x("a", data)
    path = f"file://{tmp_path}/a.gt3x"
    parts = list(R.log_parts(path, 300))
    assert len(parts) > 5 and all(p.num_rows == 1 for p in parts)
    got = columns(R.read_gt3x(spark, path, part_bytes=300))
    assert [r[1:] for r in got] == [(t.to_pydatetime(), *v) for t, v in zip(whole["time"], whole[["x", "y", "z"]].to_numpy())]


def test_a_streamed_log_has_the_records_of_the_whole(tmp_path):
    import io

    rng = np.random.default_rng(3)
    raw = b""
    for kind, second, payload in log(60):
        body = struct.pack("<BBIH", 0x1E, kind, second, len(payload)) + payload
        raw += body + bytes([D.checksum(body)])
        if rng.random() < 0.3:  # noise with false marks, and a broken record
            raw += rng.choice([0x1E, 0, 200, 7], int(rng.integers(0, 60))).astype(np.uint8).tobytes()
            raw += body[:-1] + bytes([body[-1] ^ 1, D.checksum(body)])
    for step in (1, 13, 1 << 18):
        assert list(R.streamed_records(io.BytesIO(raw), step)) == list(D.gt3x_records(raw))


def test_what_is_refused(spark, tmp_path):
    cases = {
        "idle sleep": [(0x15, 1, struct.pack("<HHI", 1, 9, 1)), *log(2)], "several": [*log(1), *log(1, kind=0x00)],
        "expected": log(2, rate=3), "no activity": [(0x02, 5, b"battery")],
    }
    for word, records in cases.items():
        path = tmp_path / f"{word.split()[0]}.gt3x"
        path.write_bytes(gt3x(records))
        with pytest.raises(ValueError, match=word):
            list(R.log_parts(f"file://{path}", 1 << 20))


def test_calibrations():
    counts = np.array([[100.0, -200.0, 300.0], [0.0, 4.0, 8.0]])
    of = lambda own: (counts - D.gt3x_calibration(own, 30.0, 256.0)[1]) @ D.gt3x_calibration(own, 30.0, 256.0)[0].T
    six = {f"{n}eroGOffset{a}": v for n, vs in (("positiveZ", (260, 250, 240)), ("negativeZ", (-250, -250, -250)), ("z", (5, 0, -5))) for a, v in zip("XYZ", vs)}
    six = {k.replace("zeroG", "zeroG"): v for k, v in six.items()}
    gain = np.array([2 / 510, 2 / 500, 2 / 490])
    assert np.allclose(of({"isCalibrated": False, "calibrationMethod": 1} | six), (counts - np.array([5, 0, -5]) * gain) * gain)
    own = {"isCalibrated": False, "calibrationMethod": 2} | {f"offset{a}_30": v for a, v in zip("XYZ", (1, 2, 3))}
    own |= {f"sensitivity{a}_30": v for a, v in {"XX": 25600, "YY": 25500, "ZZ": 25700, "XY": 10, "XZ": -20, "YZ": 0}.items()}
    xy, xz = 1 / 250.1 - 0.004, 1 / 249.8 - 0.004
    matrix = np.array([[1 / 256, xy, xz], [xy, 1 / 255, 0], [xz, 0, 1 / 257]])
    assert np.allclose(of(own), (counts - [1, 2, 3]) @ matrix.T)
    for plain in ({}, {"isCalibrated": True}, {"isCalibrated": False, "calibrationMethod": 2}):
        assert np.allclose(of(plain), counts / 256)
    with pytest.raises(ValueError, match="unknown"):
        of({"isCalibrated": False, "calibrationMethod": 9})
    assert D.gt3x_scale({"Acceleration Min": "-8,0", "Acceleration Max": "8,0"}, D.ACTIVITY2) == 4096 and D.gt3x_scale({}, D.ACTIVITY) == 256


def test_geneactiv_pages_are_counted(spark, tmp_path):
    head = "Device Identity\nDevice Type:GENEActiv\nCalibration Data\n" + "".join(f"{a} gain:100\n{a} offset:0\n" for a in "xyz") + "Volts:300\nLux:900\nMemory Status\nNumber of Pages:{}\n\n"
    page = lambda n: f"Recorded Data\nSequence Number:{n}\nPage Time:2024-05-01 10:00:0{n}:000\nMeasurement Frequency:100.0\n001002003192\n"
    for name, stated in (("a", 2), ("b", 3)):
        (tmp_path / f"{name}.bin").write_text(head.format(stated) + page(0) + page(1))
    rows = D.read_geneactiv(spark, f"file://{tmp_path}/a.bin", extras=True).collect()
    assert [(r.x, r.light, r.button) for r in rows] == [(1.0, 300.0, 1)] * 2
    with pytest.raises(Exception, match="2 pages"):
        D.read_geneactiv(spark, f"file://{tmp_path}/b.bin").collect()
