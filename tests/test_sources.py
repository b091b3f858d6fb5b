"""Files written by small encoders here are decoded back."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest

from tidemark.sources import devices as D
from tidemark.sources import tables as T


def cwa_time(year, month, day, h, m, s):
    return (year - 2000) << 26 | month << 22 | day << 17 | h << 12 | m << 6 | s


def cwa_block(packed, xyz, rate=0x4A, bps=0x32, broken=False):
    b = bytearray(512)
    struct.pack_into("<HHHIIIHHBBBBhH", b, 0, 0x5841, 508, 0, 1, 0, packed, 0, 0, 0, 0, rate, bps, 0, len(xyz))
    struct.pack_into(f"<{3 * len(xyz)}h", b, 30, *np.asarray(xyz, int).reshape(-1))
    total = int(np.frombuffer(bytes(b), "<u2").sum(dtype=np.uint32)) & 0xFFFF
    struct.pack_into("<H", b, 510, (-total + broken) & 0xFFFF)
    return bytes(b)


def test_cwa_blocks(spark, tmp_path):
    head = bytearray(1024)
    head[:2], head[36] = b"MD", 0x4A
    struct.pack_into("<HI", head, 5, 77, 9)
    one = [[256, 0, -256]] * 50
    blocks = [cwa_block(cwa_time(2024, 2, 29, 23, 59, 59), one), cwa_block(cwa_time(2024, 3, 1, 0, 0, 0), one, broken=True), cwa_block(cwa_time(2024, 3, 1, 0, 0, 0), [[0, 512, 128]] * 40)]
    (tmp_path / "a.cwa").write_bytes(bytes(head) + b"".join(blocks))
    out = D.read_recordings(spark, f"file://{tmp_path}/a.cwa").orderBy("time").toPandas()
    assert len(out) == 90
    assert out.iloc[0][["x", "y", "z"]].tolist() == [1.0, 0.0, -1.0]
    assert out.iloc[-1][["x", "y", "z"]].tolist() == [0.0, 2.0, 0.5]
    assert str(out["time"].iloc[0]) == "2024-02-29 23:59:59"
    assert str(out["time"].iloc[50]) == "2024-03-01 00:00:00"
    assert json.loads(D.read_headers(spark, f"file://{tmp_path}/a.cwa").first().header)["device"] == 77
    assert D.decode_cwa("x", b"").empty


def test_cwa_packed_samples():
    b = bytearray(cwa_block(cwa_time(2024, 1, 1, 0, 0, 0), [], bps=0x30))
    struct.pack_into("<H", b, 28, 1)
    struct.pack_into("<I", b, 30, (3 << 30) | ((-2 & 1023) << 20) | (5 << 10) | (-1 & 1023))
    struct.pack_into("<H", b, 510, 0)
    struct.pack_into("<H", b, 510, -int(np.frombuffer(bytes(b), "<u2").sum(dtype=np.uint32)) & 0xFFFF)
    out = D.decode_cwa("x", bytes(b))
    assert out[["x", "y", "z"]].iloc[0].tolist() == [-8 / 256, 40 / 256, -16 / 256]


def test_geneactiv_pages(spark, tmp_path):
    sample = lambda x, y, z: f"{x & 0xFFF:03X}{y & 0xFFF:03X}{z & 0xFFF:03X}000"
    head = "Device Identity\nDevice Type:GENEActiv\nCalibration Data\n" + "".join(f"{a} gain:100\n{a} offset:{o}\n" for a, o in zip("xyz", (0, 100, -100), strict=True)) + "Memory Status\n\n"
    page = lambda n, at, s: f"Recorded Data\nDevice Unique Serial Code:1\nSequence Number:{n}\nPage Time:{at}\nMeasurement Frequency:100.0\n{''.join(s)}\n"
    (tmp_path / "a.bin").write_text(head + page(0, "2024-05-01 10:00:00:500", [sample(1, -1, 2047), sample(-2048, 0, 0)]) + page(1, "2024-05-01 10:00:03:500", [sample(0, 0, 0)]))
    out = D.read_recordings(spark, f"file://{tmp_path}/a.bin").orderBy("time").toPandas()
    assert out[["x", "y", "z"]].to_numpy().tolist() == [[1.0, -2.0, 2048.0], [-2048.0, -1.0, 1.0], [0.0, -1.0, 1.0]]
    assert str(out["time"].iloc[1]) == "2024-05-01 10:00:00.510000"


def gt3x(records, extra=None):
    log = b""
    for kind, second, payload in records:
        body = struct.pack("<BBIH", 0x1E, kind, second, len(payload)) + payload
        log += body + bytes([D.checksum(body)])
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("info.txt", "Sample Rate: 2\nAcceleration Scale: 256\nAcceleration Min: -8\nAcceleration Max: 8\n")
        z.writestr("log.bin", log + b"\x1e\x00broken")
        for name, text in (extra or {}).items():
            z.writestr(name, text)
    return f.getvalue()


def test_gt3x_records(spark, tmp_path):
    bits = "".join(f"{v & 0xFFF:03x}" for v in (1, 256, -256, -1, 512, 128))
    words, packed = (0x1A, 100, struct.pack("<6h", 256, 0, -256, 1, 2, 3) + b"\x01"), (0x00, 101, bytes.fromhex(bits))
    # A file has records of one type; of two it is refused.
    (tmp_path / "a.gt3x").write_bytes(gt3x([words]))
    (tmp_path / "b.gt3x").write_bytes(gt3x([packed]))
    out = D.read_recordings(spark, f"file://{tmp_path}/*.gt3x").orderBy("time").toPandas()
    assert out["x"].tolist() == [1.0, 1 / 256, 1.0, 2.0]
    assert out["y"].tolist() == [0.0, 2 / 256, 1 / 256, -1 / 256]
    assert str(out["time"].iloc[1]) == "1970-01-01 00:01:40.500000"
    with pytest.raises(ValueError, match="several"):
        D.decode_gt3x("x", gt3x([words, packed]))
    with pytest.raises(ValueError, match="idle sleep"):
        D.decode_gt3x("x", gt3x([(0x15, 1, struct.pack("<HHI", 1, 9, 1))]))
    assert D.decode_gt3x("x", gt3x([(0x00, 5, b"")])).empty


@pytest.mark.parametrize(("text", "sep"), [("time;x;y;z\n2024-01-01 00:00:00;1;2;3\n2024-01-01 00:00:01;4;5;6\n", ";"), ("2024-01-01 00:00:00,1,2,3\n2024-01-01 00:00:01,4,5,6\n", ","), ("A_Z\ttimestamp\tacc_x\tay\n3\t2024-01-01 00:00:00\t1\t2\n6\t2024-01-01 00:00:01\t4\t5\n", "\t")])
def test_csv(spark, tmp_path, text, sep):
    (tmp_path / "a.csv").write_text(text)
    assert D.detect_delimiter(text) == sep
    out = D.read_recordings(spark, f"file://{tmp_path}/a.csv").orderBy("time").toPandas()
    assert out[["x", "y", "z"]].to_numpy().tolist() == [[1, 2, 3], [4, 5, 6]]


def test_unknown_files_and_headers(spark, tmp_path):
    with pytest.raises(ValueError, match="no reader"):
        D.read_recordings(spark, "a.xyz")
    (tmp_path / "b.csv").write_text("time,x,y\n2024-01-01 00:00:00,1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        D.read_csv(spark, f"file://{tmp_path}/b.csv")


def test_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_text("filename;ID;exclude\na.cwa ;p1;yes\nb.cwa;p1;\nc.cwa;p2;?\nTotal;3;\n")
    out = {r.filename: (r.record_key, r.exclude) for r in T.read_metadata(spark, f"file://{tmp_path}/m.csv").collect()}
    assert out == {"a.cwa": ("p1_rec1", "1"), "b.cwa": ("p1_rec2", "0"), "c.cwa": ("p2", "?")}
    (tmp_path / "d.csv").write_text("filename,ID\na,p1\na,p2\n")
    with pytest.raises(ValueError, match="repeated"):
        T.read_metadata(spark, f"file://{tmp_path}/d.csv")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1.5), ("r2", float("nan"))], "recording_id string, v double")
    T.write_series(df, f"file://{tmp_path}/s")
    assert T.read_series(spark, f"file://{tmp_path}/s", ["r1"]).count() == 1
    assert sorted(r.info for r in T.info_json(df).collect()) == ['{"recording_id":"r1","v":1.5}', '{"recording_id":"r2","v":null}']
    nights = spark.createDataFrame([("p", 0, 0.25), ("p", 1, 0.5), ("p", 1, 0.5)], "id string, night int, prob double")
    with pytest.raises(ValueError, match="twice"):
        T.night_predictions(nights)
    assert T.patient_predictions(nights.distinct()).first().nightly_probs == "0.2500,0.5000"
