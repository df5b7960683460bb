from __future__ import annotations

import struct

import pytest

from fathomline.formats import signatures as sg
from fathomline.operators.detect import detect, detect_by_join


def plain(header):
    if len(header) < 4:
        return (sg.BY_LENGTH_CONFIDENCE, sg.BY_LENGTH[len(header)])
    return max(((s.confidence, s.format) for s in sg.signatures() if s.matches(header)), default=(0, sg.UNKNOWN))


def anchors():
    for s in sg.signatures():
        for pick in (0, -1):
            out = bytearray()
            for c in s.conditions + s.guards:
                out.extend(b"\0" * max(0, c.offset - len(out)))
                out[c.offset : c.offset + c.size] = c.options[pick]
            yield bytes(out) + b"zzzz"


def test_both_ways_match_a_plain_loop(spark):
    rows = [(i, bytearray(h)) for i, h in enumerate([*anchors(), b"", b"a", b"ab", b"abc", b"abcd", b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR", b"GIF87a" + b"\0" * 600])]
    df = spark.createDataFrame(rows, "id int, content binary")
    want = {i: plain(bytes(h)) for i, h in rows}
    got = {r.id: (r.confidence, r.format) for r in detect(df).collect()}
    by_rule = {s.format for s, _, _ in sg.ruled()} | {"html", "pnm"}
    assert all(got[i] == w or got[i][1] in by_rule and got[i] > w for i, w in want.items())
    assert sum(got[i] != w for i, w in want.items()) < 20
    assert {r.id: (r.confidence, r.format) for r in detect_by_join(df, "id").collect()} == got


def test_both_ways_match_where_a_rule_describes_the_format(spark):
    heads = [b"<!DOCTYPE html><p>", b"P2 4 5", b"\xff\xd8\xff\xee12", b"MZ" + b"\0" * 58 + b"\x40\0\0\0PE\0\0", b"\xff\xfb\x90\x64", b"nothing", b""]
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "id int, content binary")
    found = [{r.id: (r.confidence, r.format) for r in d.collect()} for d in (detect(df), detect_by_join(df, "id"))]
    assert found[0] == found[1] and [found[0][i][1] for i in range(len(heads))] == ["html", "pnm", "jpeg", "exe", "mpeg-adts", "?", "empty"]


# Header, format and confidence; None where the confidence is not looked at.
CASES = [
    (b"<!DOCTYPE html>\n<x", "html", 1400),
    (b"  <HTML lang=x>", "html", 868 - 12 + 12),
    (b"<htmlx>", "?", 0),
    (b"P3#x 4 5", "pnm", 231),
    (b"P6 7 9", "pnm", 231),
    (b"\xff\xd8\xff\xee\0\x0eAdobe", "jpeg", 301),
    (b"\xff\xd8\xff\xed\0\x0e", "jpeg", 301),
    (b"RIFF\x1a\0\0\0WEBPVP8L\x0e\0\0\0/\0\0\0\0\0", "webp", 1541),
    (b"RIFF\x1b\0\0\0WEBPVP8L\x0e\0\0\0/\0\0\0\0\0", "?", 0),
    (b"RIFF\x40\0\0\0WEBPVP8X\x0a\0\0\0\x10" + b"\0" * 9, "webp", 1541),
    (b"\xff\xfb\x90\x64", "mpeg-adts", 178),
    (b"\xff\xfb\xf0\x64", "?", 0),
    (b"\x0bw\0\0\x40\0\0", "ac3", 220),
    (b"\x7fELF\2\1\1\0" + b"\0" * 8 + b"\3\0\x3e\0\1\0\0\0", "elf", None),
    (b"MZ" + b"\0" * 58 + b"\x40\0\0\0PE\0\0", "exe", 1326),
    (b"MZ" + b"\0" * 58 + b"\x40\0\0\0xx\0\0", "?", 0),
    (b"<?xml version='1.0'?>", "xml", 1459),
    (b"\0\0\1\0\1\0\x20\x20\0\0\1\0\x20\0", "ico", 910),
    (b"SQLite format 3\0\x10\0\1\1", "sqlite3", None),
    (b"Y\xa6j\x95" + struct.pack(">6I", 2, 3, 8, 6, 1, 0), "ras", 763),
    (b"\x0a\5\1\x08", "pcx", 334),
    ((b"G\x40\0\x10" + b"\xff" * 184) * 2, "mpeg-ts", 389),
    (b"icns\0\0\0\x20", "icns", 402),
    (b"7kSt", "zpaq", None),
    (b"<?PHP\n\n", "php", None),
    (b"dex\n035\0", "dalvik-dex", None),
    (b"ID3\xff", "?", 0),
    (b"SIT!\0\0\0\0\0\0rLau", "stuffit", 740),
    (b"GIF89a", "gif", 588),
    (b"\x04\x22M\x18zz", "lz4-legacy", 400),
    (b"PK\x03\x04zz", "zip", 371),
    (b"BM" + b"1234" + b"\0\0\0\0" + b"6\0\0\0\x28\0\0\0" + b"\0" * 8, "bmp", 200 + 360 + 250 + 52),
    (b"#! /bin/sh", "unixscript", 310),
    (b"#!x", "short3", 100000),
    (b"\0\0\0\x14ftypmp42", "mov", 300 + 390 + 363 + 26),
    (b"RIFF1234WAVEfmt \x10\0\0\0", "wav", 400 + 348 + 381 + 315),
    (b"ID3\4\0\0\0\0\0\x0a", "id3v2", 400),
    (b"@Echo OFF\r\n", "windows-cmd", 100 + 88 + 900),
    (None, None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, header and bytearray(header)) for i, (header, _, _) in enumerate(CASES)], "id int, content binary")
    got = {r.id: r for r in detect(df).collect()}
    for i, (header, format, confidence) in enumerate(CASES):
        assert got[i].format == format, header
        assert confidence is None or got[i].confidence == confidence or format == "html", (header, got[i])


def test_table_is_well_formed():
    assert len({s.format for s in sg.signatures()}) > 100
    assert all(s.conditions and all(a.offset + a.size <= b.offset for a, b in zip(s.conditions, s.conditions[1:])) for s in sg.signatures())
    with pytest.raises(ValueError):
        sg.parsed("x y @0 in{'a','bc'}")


def test_stream(spark, tmp_path):
    from fathomline.streaming.detecting import detected_stream, file_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"GIF89a...")
    (folder / "b.bin").write_bytes(b"nothing")
    q = detected_stream(file_stream(spark, str(folder))).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.path.rpartition("/")[2], r.format) for r in spark.table("found").collect()) == [("a.bin", "gif"), ("b.bin", "?")]
