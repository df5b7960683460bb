from __future__ import annotations

import lzma
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.analyzers import walkers

RECTANGLE = int("01111" + "".join(f"{n:015b}" for n in (0, 8000, 20, 6020)) + "0" * 7, 2).to_bytes(9, "big") + b"\0" * 12
SQUEEZED = lzma.compress(RECTANGLE, lzma.FORMAT_ALONE)
EMF = struct.pack("<II8i", 1, 88, 0, 0, 9, 9, 100, 200, 2640, 5280) + b" EMF\0\0\1\0" + b"\0" * 40
ASF_HEAD = bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c")


def stream(kind, body):
    body = kind + b"\0" * 38 + body
    return bytes.fromhex("9107dcb7b7a9cf118ee600c00c205365") + struct.pack("<Q", 24 + len(body)) + body


VIDEO = stream(bytes.fromhex("c0ef19bc4d5bcf11a8fd00805f5c442b"), struct.pack("<IIBHIIIHH4s", 352, 288, 2, 40, 40, 352, 288, 1, 24, b"WMV2"))
SOUND = stream(bytes.fromhex("409e69f84d5bcf11a8fd00805f5c442b"), struct.pack("<HHIIHH", 0x161, 2, 44100, 0, 0, 16))


def asf(*parts):
    return ASF_HEAD + struct.pack("<QIH", 30 + sum(map(len, parts)), len(parts), 0x201) + b"".join(parts)


PICTURES = [
    ("alias-pix", struct.pack(">5H", 17, 23, 0, 0, 24), {"width": 17, "height": 23, "codec": "rle"}),
    ("cineon", b"\x80\x2a\x5f\xd7" + b"\0" * 196 + struct.pack(">II", 40, 50), {"width": 40, "height": 50}),
    ("cineon", b"\xd7\x5f\x2a\x80" + b"\0" * 196 + struct.pack("<II", 40, 50), {"width": 40, "height": 50}),
    ("cmuwm", b"\xbb\x40\0\xf1" + struct.pack("<II", 4, 5), {"width": 4, "height": 5, "codec": "uncompressed"}),
    ("cmuwm", b"\xf1\0\x40\xbb" + b"\0", {"width": None, "codec": "uncompressed"}),
    ("deep", b"FORM1234DEEPDGBL\0\0\0\x08" + struct.pack(">HHH", 6, 7, 4), {"width": 6, "height": 7, "codec": "jpeg"}),
    ("dpx", b"SDPX\0\0\0\0V1.0" + b"\0" * 760 + struct.pack(">II", 90, 80) + b"\0" * 26 + b"\0\1", {"width": 90, "height": 80, "codec": "rle"}),
    ("lbm", b"FORM1234ILBMBMHD\0\0\0\x14" + struct.pack(">HH", 33, 44), {"width": 33, "height": 44, "codec": "rle", "subformat": "ilbm"}),
    ("lbm", b"FORM1234PBM BMHD\0\0\0\x14", {"width": None, "codec": "uncompressed", "subformat": "pbm"}),
    ("minolta-raw", b"\0MRM1234\0PRD\0\0\0\x18" + b"\0" * 12 + struct.pack(">HH", 3, 4), {"width": 4, "height": 3}),
    ("utah-rle", b"\x52\xcc" + struct.pack("<4H5B", 1, 1, 20, 30, 2, 3, 8, 0, 8), {"width": 20, "height": 30, "codec": "rle"}),
    ("utah-rle", b"\x52\xcc" + struct.pack("<4H5B", 1, 1, 20, 30, 2, 3, 9, 0, 8), {"error": "bad_data"}),
    ("xcf", b"gimp xcf file\0" + struct.pack(">II", 5, 6), {"width": 5, "height": 6, "codec": None}),
    ("xv-pm", b"VIEW" + struct.pack(">5I", 3, 12, 13, 1, 0x8001), {"width": 13, "height": 12}),
    ("xv-pm", b"WEIV" + struct.pack("<5I", 3, 12, 13, 1, 0x8004), {"error": "bad_data"}),
    ("art", b"JG\4\x0e\0\0\0\0\7\0\x40\x15\3" + struct.pack("<HH", 9, 8), {"width": 9, "height": 8}),
    ("art", b"JG\3\x0e\0\0\0\4\x8e\2\x0a\0" + struct.pack("<HH", 9, 8), {"width": 8, "height": 9}),
    ("fbm", b"%bitmap\0" + b"120\0\0\0\0\0" + b"75\0\0\0\0\0\0", {"width": 120, "height": 75}),
    ("macpaint", b"", {"width": 576, "height": 720}),
    ("psp", b"Paint Shop Pro Image File\n\x1a\0\0\0\0\0" + struct.pack("<HH4sHIIII", 3, 0, b"~BK\0", 0, 46, 46, 64, 32) + b"\0" * 9 + b"\1\0", {"width": 64, "height": 32, "codec": "rle"}),
    ("flif", b"FLIF\x331\x81\x00\x09", {"width": 129, "height": 10}),
    ("flif", b"FLIF\x331" + b"\xff" * 20, {"error": "bad_data"}),
    ("fuif", b"FUAF3-\x07\x08", {"width": 8, "height": 9, "subformat": "fuaf"}),
    ("djvu", b"AT&TFORM\0\0\0\x20DJVUINFO\0\0\0\x0a" + struct.pack(">HH", 7, 8), {"width": 7, "height": 8, "subformat": "djvu"}),
    ("djvu", b"AT&TFORM\0\0\0\x40DJVMDIRM\0\0\0\x02xxFORM\0\0\0\x20DJVUINFO\0\0\0\x0a" + struct.pack(">HH", 7, 8), {"width": 7, "height": 8, "subformat": "djvm"}),
    ("djvu", b"AT&TFORM\0\0\0\x09DJVMDIRM\0\0\0\x02xx", {"error": "bad_data"}),
    ("miff", b"id=ImageMagick\nColumns=30 rows=40\ncompression=Zip\n\x0c\n:\x1axx", {"width": 30, "height": 40, "codec": "flate"}),
    ("miff", b"id=ImageMagick columns=99999999999999999999 rows=2 :\x1a", {"width": None, "height": 2, "error": "bad_data"}),
    ("miff", b"id=ImageMagick columns=3", {"error": "bad_data"}),
    ("vicar", b"LBLSIZE=80 FORMAT='NS=3 x' NL=5 NS = 6".ljust(80), {"width": 6, "height": 5}),
    ("sun-taac", b"ncaa\nrank=2;\nsize=30 20;\n\x0c\n", {"width": 30, "height": 20}),
    ("xpm", b"/* XPM */\nstatic char *a[] = {\n\"16 9 2 1\",", {"width": 16, "height": 9, "subformat": "xpm3"}),
    ("xpm", b"! XPM2\n16 9 2 1\n", {"width": 16, "height": 9, "subformat": "xpm2"}),
    ("xwd", struct.pack(">7I", 100, 7, 2, 24, 640, 480, 0), {"width": 640, "height": 480, "subformat": "x11"}),
    ("xwd", struct.pack("<7I", 40, 6, 2, 3, 1, 64, 48), {"width": 64, "height": 48, "subformat": "x10"}),
    ("qtif", struct.pack(">I4s", 12, b"iicc") + b"1234" + struct.pack(">I4sI4s", 94, b"idsc", 86, b"jpeg") + b"\0" * 24 + struct.pack(">HH", 11, 12), {"width": 11, "height": 12, "codec": "jpeg"}),
    ("emf", EMF, {"width": 72, "height": 144, "subformat": "emf"}),
    ("emf", EMF + struct.pack("<IIII4sHHII", 70, 44, 32, 0, b"EMF+", 0x4001, 1, 28, 16)[:12] + b"EMF+\1@\1\0", {"subformat": "dual"}),
    ("wmf", b"\xd7\xcd\xc6\x9a\0\0" + struct.pack("<5HI", 0, 0, 500, 1000, 1000, 0), {"width": 36, "height": 72}),
    ("swf", b"FWS\5\0\0\0\0" + RECTANGLE, {"width": 400, "height": 300, "codec": "uncompressed"}),
    ("swf", b"CWS\6\0\0\0\0" + zlib.compress(RECTANGLE), {"width": 400, "height": 300, "codec": "flate"}),
    ("swf", b"ZWS\x0d\0\0\0\0\0\0\0\0" + SQUEEZED[:5] + SQUEEZED[13:], {"width": 400, "height": 300, "codec": "lzma"}),
    ("swf", b"CWS\5\0\0\0\0" + zlib.compress(RECTANGLE), {"error": "bad_data"}),
    ("yuv4mpeg2", b"YUV4MPEG2 W320 H200 F25:1\nFRAME\n", {"width": 320, "height": 200, "vcodec": "uncompressed"}),
    ("yuv4mpeg2", b"YUV4MPEG2 W320 W200\nFRAME\n", {"error": "bad_data"}),
    ("ani", b"RIFF1234ACONanih\x24\0\0\0" + struct.pack("<9I", 36, 1, 1, 0, 0, 0, 0, 9, 1) + b"LIST\x20\0\0\0framicon\x10\0\0\0\0\0\2\0\1\0\x30\x20", {"width": 48, "height": 32}),
    ("asf", asf(VIDEO, SOUND), {"format": "wmv", "vcodec": "wmv2", "width": 352, "height": 288, "acodec": "wmav2", "anch": 2, "arate": 44100}),
    ("asf", asf(SOUND), {"format": "wma", "acodec": "wmav2", "asbits": 16}),
    ("asf", asf(SOUND)[:90], {"error": "bad_data"}),
    ("ape", b"MAC \x6e\x0f\xd0\7\2\0" + struct.pack("<HI", 2, 44100), {"acodec": "ape", "anch": 2, "arate": 44100}),
    ("ape", b"MAC " + struct.pack("<HHH", 3990, 0, 52) + b"\0" * 60 + struct.pack("<HI", 1, 96000), {"anch": 1, "arate": 96000}),
    ("oggpcm", b"PCM     " + struct.pack(">HHIIBB", 0, 0, 2, 48000, 0, 2), {"acodec": "pcm", "asbits": 16, "arate": 48000, "anch": 2}),
    ("wasm", b"\0asm\1\0\0\0", {"subformat": "binary"}),
    ("elf", b"\x7fELF\2\1\1" + b"\0" * 20, {"subformat": "64bit"}),
    ("lua-luac", b"\x1bLua\x53", {"subformat": "5.3"}),
    ("aifc", b"FORM1234AIFCCOMM\0\0\0\x18" + struct.pack(">HIHHQ", 2, 9, 16, 0x400E, 0xAC44 << 48) + b"ulaw\0\0", {"acodec": "mulaw", "anch": 2, "arate": 44100, "format": "aifc"}),
    ("pnm", b"P2 9999999999999999999999 7 1 ", {"width": None, "height": 7, "error": "bad_data"}),
]


def test_pictures(spark):
    rows = [(i, f, bytearray(d)) for i, (f, d, _) in enumerate(PICTURES)]
    got = {r.id: r.asDict() for r in walkers.walked(spark.createDataFrame(rows, "id int, format string, content binary").repartition(3)).collect()}
    for i, (_, _, want) in enumerate(PICTURES):
        assert {k: got[i][k] for k in want} == want, PICTURES[i]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_damaged_headers_are_refused_in_order(data):
    """Cut and altered headers give values or an error that walked() knows, never another exception."""
    kind, header, _ = data.draw(st.sampled_from(PICTURES))
    header = bytearray(header[: data.draw(st.integers(0, len(header)))])
    for at, value in data.draw(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 255)), max_size=4)):
        if at < len(header):
            header[at] = value
    try:
        assert isinstance(walkers.WALKERS[kind](bytes(header)), dict)
    except (ValueError, struct.error, IndexError):
        pass


def test_files_beyond_their_beginnings(spark, tmp_path):
    """Values that stand behind the bytes read for detection come from the file."""
    file = tmp_path / "pages.djvu"
    file.write_bytes(b"AT&TFORM" + struct.pack(">I", 200_000) + b"DJVMDIRM" + struct.pack(">I", 100_000) + b"\0" * 100_000 + b"FORM\0\0\0\x20DJVUINFO\0\0\0\x0a" + struct.pack(">HH", 70, 80))
    rows = spark.createDataFrame([(str(file), "djvu", bytearray(file.read_bytes()[:65536]))], "f string, format string, content binary")
    r = walkers.walked(rows, name="f", limit=65536).first()
    assert (r.width, r.height, r.error) == (70, 80, None)
