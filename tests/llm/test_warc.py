"""Archives: round trip, the reader against broken and foreign archives, edge cases."""

import hashlib
import os
import random

import pytest
import zstandard

from plantgauge.llm import warc
from plantgauge.session import fresh_folder

PAGES = "page_id long, url string, html string, digest string, payload string, refers_to long, path string, content string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", -1, "p", "c") for r in rows], PAGES)


def brute(rows):
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    out = []
    for p, u, h in rows:
        body = (h or "").encode()
        at = first.get(h)
        again = at is not None and (p is None or p > at)
        out.append((p, u, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", at if again else None))
    return sorted(out, key=repr)


def through(spark, rows, **options):
    path = fresh_folder(spark, "warc")
    warc.write_archives(make(spark, rows), path, **options)
    return path, warc.read_archives(spark, path)


def settled(df):
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


ROWS = [
    (5, "http://a/", "x" * 100), (3, "http://b/", "x" * 100), (9, None, "x" * 100), (3, "http://b/", "x" * 100),
    (1, "http://c/%0A", "y" * 99), (2, "http://c/", "y" * 99), (None, "http://d/", "x" * 100), (None, "http://e/", "z" * 200),
    (7, " http://f/\r\nWARC-Type: x ", "é" * 60), (8, "", "é" * 60), (10, "http://g/é", None), (11, "http://g/", ""),
    (12, "http://h/", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (-4, "http://i/", "a\x00b" * 50_000),
]


def test_round_trip(spark):
    path, df = through(spark, ROWS)
    assert settled(df) == brute(ROWS)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in df.where("record_type = 'response'").collect()}
    assert payloads[12] == ROWS[12][2] and payloads[-4] == ROWS[13][2] and payloads[10] == ""
    assert df.where("fault is not null").count() == 0


def test_empty_table(spark):
    assert through(spark, [])[1].collect() == []


def page(i, rng):
    words = ["<div class='item'>", "<p>", "</p>", "word", "other", "text", "</div>"]
    return f"<html><head><title>{i}</title></head>" + "".join(rng.choice(words) for _ in range(300))


def archives(path):
    return [open(os.path.join(path, n), "rb").read() for n in sorted(os.listdir(path)) if n.startswith("part-")]


def test_dictionary_and_rolled_archives(spark):
    rng = random.Random(3)
    rows = [(i, f"http://p/{i}", page(i % 900, rng) if i % 3 else "same " * 40) for i in range(1500)]
    path, df = through(spark, rows, archive_bytes=400_000)
    assert settled(df) == brute(rows)
    found = archives(path)
    assert len(found) > 4
    with_dictionary = [a for a in found if int.from_bytes(a[:4], "little") == warc.DICTIONARY_FRAME]
    assert with_dictionary
    # one frame per record, each of them unreadable without the dictionary
    a = with_dictionary[0]
    at = 8 + int.from_bytes(a[4:8], "little")
    end = warc.frame_end(memoryview(a), at)
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(a[at:end])
    info = [r for r, _ in warc.records_of(a)][0]
    assert b"WARC-Type: warcinfo" in info and warc.parsed(info) is None


def records(a):
    out = []
    for record, fault in warc.records_of(a):
        try:
            out.append(fault or (warc.parsed(record) or {}).get("page_id", "other"))
        except warc.Fault as e:
            out.append(str(e))
    return out


def test_reader_validates():
    body = b"z" * 300
    digest = hashlib.sha256(body).hexdigest()
    good = warc.web_record(4, "http://a/", body, digest, None, "2020-01-01T00:00:00Z")
    again = warc.web_record(6, "http://a/", body, digest, 4, "2020-01-01T00:00:00Z")
    press = zstandard.ZstdCompressor(write_checksum=True).compress
    assert records(press(good) + warc.EMPTY_FRAME.encode() + press(again)) == [4, 6]
    broken = {
        good.replace(b"zzzz", b"zzzy", 1): "payload digest differs",
        good.replace(b"Content-Length: 3", b"Content-Length: 4", 1): "block length differs from content-length",
        good[:-1]: "block length differs from content-length",
        good.replace(b"WARC/1.1", b"WARC/0.9"): "no record header",
        good.replace(b"WARC-Date", b"WARC-Dote"): "no warc-date",
        good.replace(b"WARC-Type: ", b"WARC-Type; "): "header line without a name",
        good.replace(b"<urn:page:4:", b"<urn:uuid:4:"): "record id of another kind",
        again.replace(b"identical", b"identicol"): "not a revisit of an identical payload",
        b"": "no record header",
    }
    for record, fault in broken.items():
        assert records(press(record) + press(again)) == [fault, 6]
    frame = press(good)
    assert records(frame[:-5]) == ["truncated frame"]
    assert records(frame + b"junk") == [4, "not a frame"]
    flipped = bytearray(frame)
    flipped[-1] ^= 1  # the checksum
    assert records(bytes(flipped) + press(again))[1] == 6 and records(bytes(flipped))[0].startswith("frame")
    assert records(b"") == []
    assert records(warc.DICTIONARY_FRAME.to_bytes(4, "little") + (99).to_bytes(4, "little") + b"ab") == ["truncated skippable frame"]


def test_plain_dictionary_and_frames_without_size():
    rng = random.Random(5)
    made = []
    for i in range(60):
        body = page(i, rng).encode()
        made.append(warc.web_record(i, None, body, hashlib.sha256(body).hexdigest(), None, "2020-01-01T00:00:00Z"))
    raw = zstandard.train_dictionary(4096, made).as_bytes()
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False)
    archive = warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
    archive += b"".join(press.compress(m) for m in made)
    assert records(archive) == list(range(60))


def test_strict_reader_stops(spark, tmp_path):
    (tmp_path / "part-0.warc.zst").write_bytes(b"no archive at all")
    assert [r["fault"] for r in warc.read_archives(spark, str(tmp_path)).collect()] == ["not a frame"]
    with pytest.raises(Exception, match="not a frame"):
        warc.read_archives(spark, str(tmp_path), strict=True).collect()
