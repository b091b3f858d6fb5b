"""Archives that other programs wrote."""

import base64
import hashlib

import pytest

from tidemark.llm import warc

TEXT = b"some payload of a page"


def foreign(digest, n=1, extra=b"", kind=b"resource"):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:x:%d>" % n, b"WARC-Payload-Digest: " + digest.encode(), b"WARC-Block-Digest: " + digest.encode()]
    return b"\r\n".join([*head, *([extra] if extra else []), b"Content-Length: %d" % len(TEXT)]) + b"\r\n\r\n" + TEXT + b"\r\n\r\n"


SHA1 = hashlib.sha1(TEXT)
DIGESTS = [
    "sha256:" + hashlib.sha256(TEXT).hexdigest(), "md5:" + hashlib.md5(TEXT).hexdigest().upper(), "sha1:" + SHA1.hexdigest(),
    "sha1:" + base64.b32encode(SHA1.digest()).decode().lower(), "SHA-256:" + base64.b32encode(hashlib.sha256(TEXT).digest()).decode(), "blake9:abc",
]


@pytest.mark.parametrize("digest", DIGESTS)
def test_digests_are_checked_by_their_own_algorithm(digest):
    good = foreign(digest)
    assert [r.kind for r in warc.salvage(good, "p")] == ["record"]
    bad = [r.kind for r in warc.salvage(good.replace(b"a page", b"a pagE"), "p")]
    assert bad == (["record"] if digest.startswith("blake9") else ["gap"])


@pytest.mark.parametrize("wrong", [foreign(DIGESTS[0], extra=b"WARC-Target-URI: http://x/\xe9"), foreign("sha1:no digest", kind=b"revisit"), foreign("sha1:" + "1" * 32)])
def test_what_cannot_be_decoded_is_a_gap(wrong):
    rows = list(warc.salvage(foreign(DIGESTS[0]) + wrong + foreign(DIGESTS[0], 3), "p"))
    assert [r.kind for r in rows] == ["record", "gap", "record"]
    assert rows[1].length == len(wrong)


def test_hex_digest_of_a_revisit():
    (row,) = warc.salvage(foreign(DIGESTS[2], kind=b"revisit"), "p")
    assert (row.kind, row.payload_digest) == ("record", SHA1.hexdigest())


def test_all_records_of_a_member_are_read():
    first = warc.member(b"".join(foreign(DIGESTS[0], n) for n in (1, 2, 3)))
    broken = warc.member(foreign(DIGESTS[0], 4) + foreign(DIGESTS[0], 5).replace(b"a page", b"a pagE") + foreign(DIGESTS[0], 6))
    rows = list(warc.salvage(first + broken, "p"))
    assert [(r.kind, r.record_id) for r in rows] == [("record", f"urn:x:{n}") for n in (1, 2, 3, 4, 6)] + [("gap", None)]
    assert {(r.offset, r.length) for r in rows} == {(0, len(first)), (len(first), len(broken))}


def test_round_trip_fails_on_a_gap(spark, monkeypatch):
    real = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda m: real(m).withColumn("kind", warc.F.lit("gap")).withColumn("reason", warc.F.lit("x")))
    df = spark.createDataFrame([(1, "http://x/", "text")], "page_id long, url string, html string")
    with pytest.raises(Exception, match="gap in"):
        warc.round_trip(df).collect()


def test_a_folded_header_line_goes_on_with_the_value_before_it():
    folded = foreign(DIGESTS[0]).replace(b"WARC-Record-ID: <urn:x:1>", b"WARC-Record-ID:\r\n\t<urn:x:1>\r\nX-Note: one\r\n  two")
    (row,) = warc.salvage(folded, "p")
    assert (row.kind, row.record_id) == ("record", "urn:x:1")
    assert list(warc.header_lines(b"A: b\r\n c\r\nD: e", 0, 14)) == [("a", "b c"), ("d", "e")]
    # A line that goes on with nothing is malformed.
    assert [r.kind for r in warc.salvage(foreign(DIGESTS[0]).replace(b"WARC-Type: ", b" WARC-Type "), "p")] == ["gap"]


def test_false_marks_are_searched_for_once():
    import time

    good = foreign(DIGESTS[0])
    for noise in (b"WARC/1.0\r\nno header\r\n", b"\x1f\x8b\x08\x00\x00"):
        data = noise * 8000 + b"\x00" * (2 << 20) + good
        began = time.perf_counter()
        rows = list(warc.salvage(data, "p"))
        assert [r.kind for r in rows] == ["gap", "record"] and rows[0].length == len(data) - len(good)
        assert time.perf_counter() - began < 3


def test_marks():
    m = warc.Marks(b"..ab..ab..")
    assert [m.after(b"ab", i) for i in (0, 1, 2, 3, 6, 7, 0)] == [2, 2, 2, 6, 6, 10, 2]


def test_a_bomb_is_a_gap_where_archives_come_from_elsewhere(monkeypatch):
    monkeypatch.setattr(warc, "BOMB_BYTES", 1 << 20)
    good = warc.member(foreign(DIGESTS[0]))
    bomb = warc.member(b"\x00" * (50 << 20))
    rows = list(warc.salvage(good + bomb + good, "p", bomb=True))
    assert [r.kind for r in rows] == ["record", "gap", "record"] and "unpacks" in rows[1].reason
    # A large member of ordinary text is none.
    import random

    text = random.Random(1).randbytes(300_000).hex().encode()
    large = foreign(DIGESTS[-1]).replace(TEXT, text).replace(b"Content-Length: %d" % len(TEXT), b"Content-Length: %d" % len(text))
    assert [r.kind for r in warc.salvage(warc.member(large), "p", bomb=True)] == ["record"]
