from __future__ import annotations

import hashlib
import os
import struct

from fathomline.plans.scan import info_lines, scan
from fathomline.sources.info_lines import parsed_lines, read_info_lines, snapshot
from pyspark.sql import functions as F

from tests.test_analyzers import GIF_IMAGE, IHDR


def test_scan_twice(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    (root / "a.png").write_bytes(IHDR)
    (root / "b c.txt").write_bytes(b"some text")
    (root / "d.th.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (root / "e.gz").write_bytes(b"\x1f\x8b\x08\0")
    (root / "none").write_bytes(b"")
    os.symlink("gone", root / "link")
    first = scan(spark, [str(root)], thumbnails=False)
    rows = {os.path.basename(r.f): r for r in first.collect()}
    assert {k: r.format for k, r in rows.items()} == {"a.png": "png", "b c.txt": "?", "e.gz": "gz", "none": "empty", "link": "symlink"}
    assert (rows["a.png"].width, rows["a.png"].height, rows["a.png"].codec, rows["e.gz"].codec) == (333, 4000, "flate", "flate")
    assert rows["b c.txt"].sha256 == hashlib.sha256(b"some text").hexdigest() and rows["link"].symlink == "gone"
    out = str(tmp_path / "lines")
    info_lines(first).write.text(out)
    old = snapshot(read_info_lines(spark, out).withColumn("n", F.monotonically_increasing_id()), "n")
    assert old.count() == 5 and parsed_lines(spark.read.text(out)).where("error is not null").count() == 0
    assert scan(spark, [str(root)], old, thumbnails=False).count() == 0
    (root / "e.gz").write_bytes(b"\x1f\x8b\x08??")
    assert [os.path.basename(r.f) for r in scan(spark, [str(root)], old, thumbnails=False).collect()] == ["e.gz"]


def test_options_spread_and_diagnostics(spark, tmp_path):
    from fathomline.plans.scan import TAGS, diagnostics, listed
    from fathomline.sources.listing import SPREAD, spread, walk

    root = tmp_path / "a:b"
    for k in range(40):
        (root / f"d{k % 8}" / f"e{k}").mkdir(parents=True)
        (root / f"d{k % 8}" / f"e{k}" / "f.gif").write_bytes(b"GIF89a\3\0\4\0\0\0\0;")
    (root / "top.bin").write_bytes(b"12345")
    os.symlink("d1", root / "to-folder")
    os.utime(root / "top.bin", (10, 10))
    every = sorted(r[0] for r in walk(str(root), 0))
    parts = spread([str(root)], 9)
    assert len(every) == 42 and sorted(r[0] for p, deep in parts for r in walk(p, 0, deep)) == every and len(parts) > 9 and SPREAD >= len(parts)
    assert [r[0] for r in walk(str(root), 0)][:3] == [str(root / "to-folder"), str(root / "top.bin"), str(root / "d0" / "e0" / "f.gif")]
    assert sorted(r.f for r in listed(spark, [str(root)]).collect()) == every
    assert [r.f for r in listed(spark, [str(root)], before=11).collect()] == [str(root / "top.bin")]
    try:
        os.setxattr(root / "top.bin", TAGS, b"blue sky")
        told = {r.f: r.tags for r in listed(spark, [str(root)], tags=True).collect()}
        assert told[str(root / "top.bin")] == "blue sky" and set(told.values()) == {"blue sky", ""}
    except OSError:
        pass  # a file system without extended attributes
    missing = diagnostics(spark, [str(root / "none")]).collect()
    assert [(r.f, r.error) for r in missing] == [(str(root / "none"), "bad_stat")]
    bad = scan(spark, [str(root)], errors=True).withColumn("error", F.when(F.col("f").endswith(".bin"), "bad_open"))
    assert [r.error for r in diagnostics(spark, [str(root)], bad).collect()] == ["bad_open"]


def test_parameters_far_into_a_file(spark, tmp_path):
    root, many = tmp_path / "files", 200_000
    root.mkdir()
    frame = b",\0\0\0\0\1\0\1\0\0\2" + (b"\xff" + b"p" * 255) * 800 + b"\0"
    entry = lambda tag, value: struct.pack("<HHII", tag, 4, 1, value)
    files = {
        "a.gif": b"GIF89a\3\0\4\0\0\0\0" + frame + GIF_IMAGE + b";",
        "b.gif": b"GIF89a\3\0\4\0\0\0\0" + frame + b";",
        "c.tif": b"II*\0" + struct.pack("<I", 8 + many) + b"p" * many + struct.pack("<H", 10) + entry(256, 70) + entry(257, 90) + entry(259, 5) + entry(300, 0) * 7,
        "d.jpg": b"\xff\xd8" + (b"\xff\xe1\xff\xff" + b"p" * 65533) * 3 + b"\xff\xc0\0\x11\x08\0\x10\0\x20" + b"\0" * 12,
        "e.wav": b"RIFF1234WAVEJUNK" + struct.pack("<I", many) + b"p" * many + b"fmt \x10\0\0\0" + struct.pack("<HHIIHH", 1, 2, 44100, 0, 0, 16),
        "f.png": IHDR + struct.pack(">I", many) + b"iCCP" + b"p" * many + b"crc!" + struct.pack(">I", 8) + b"acTL" + b"\0" * 12,
        "g.jpg": b"\xff\xd8" + b"\xff\xe1\xff\xff" + b"p" * 65533 + b"\xff\xe1\xff\xff",
    }
    for name, data in files.items():
        (root / name).write_bytes(data)
    rows = {os.path.basename(r.f): r for r in scan(spark, [str(root)]).collect()}
    assert {k: r.format for k, r in rows.items()} == {"a.gif": "agif", "b.gif": "gif", "c.tif": "tiff", "d.jpg": "jpeg", "e.wav": "wav", "f.png": "apng", "g.jpg": "jpeg"}
    assert (rows["c.tif"].width, rows["c.tif"].height, rows["c.tif"].codec) == (70, 90, "lzw")
    assert (rows["d.jpg"].width, rows["d.jpg"].height, rows["d.jpg"].error) == (32, 16, None)
    assert (rows["e.wav"].acodec, rows["e.wav"].anch, rows["e.wav"].arate, rows["e.wav"].asbits) == ("pcm", 2, 44100, 16)
    assert rows["g.jpg"].error == "bad_data" and all(rows[k].sha256 == hashlib.sha256(data).hexdigest() for k, data in files.items())
