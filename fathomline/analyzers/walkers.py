"""Media parameters of formats that have to be walked through: chunks, segments and bit fields.

Each walker is a pure function of a file's bytes, as bytes or as FileBytes, which reads what is asked for; it
gives what it could read, and raises ValueError for bad data. They run in batches over Arrow, and no error of one file stops another.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable
from fractions import Fraction
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fathomline.analyzers import containers, pictures
from fathomline.functions.dimensions import CHANNEL_RANGE, RATE_RANGE

NAMES = {"format": StringType(), "width": LongType(), "height": LongType(), "codec": StringType(), "subformat": StringType(), "vcodec": StringType(), "acodec": StringType(), "anch": LongType(), "arate": LongType(), "asbits": LongType(), "error": StringType()}
# Codecs by format number of WAVE audio.
WAVE_CODECS = {
    0x0001: "pcm", 0x0002: "adpcm", 0x0003: "pcm", 0x0006: "alaw", 0x0007: "mulaw", 0x0009: "drm", 0x000A: "wma", 0x0010: "adpcm", 0x0011: "adpcm", 0x0012: "adpcm", 0x0013: "adpcm",
    0x0017: "adpcm", 0x0018: "adpcm", 0x0020: "adpcm", 0x0028: "lrc", 0x0030: "ac2", 0x0036: "adpcm", 0x003B: "adpcm", 0x0050: "mp2", 0x0055: "mp3", 0x0064: "adpcm", 0x0065: "adpcm",
    0x0075: "rt29", 0x0092: "ac3", 0x00FF: "aac", 0x0160: "wmav1", 0x0161: "wmav2", 0x0162: "wma-pro", 0x0163: "wma-lossless", 0x0164: "wma-spdif", 0x0200: "adpcm", 0x0240: "raw_sport",
    0x0241: "esst_ac3", 0x1600: "aac", 0x1602: "mpeg_loas", 0x1610: "mpeg_heaac", 0x2000: "dvm", 0x2001: "dts2", 0xFFFE: "extensible-?",
}
# Codec and bits of a sample by encoding number of Sun audio.
SUN_CODECS = {1: ("mulaw", 8), 2: ("pcm", 8), 3: ("pcm", 16), 4: ("pcm", 24), 5: ("pcm", 32), 6: ("pcm", 32), 7: ("pcm", 64), 23: ("adpcm", 4), 24: ("adpcm", 1), 25: ("adpcm", 3), 26: ("adpcm", 5), 27: ("alaw", 8)}
# Compression of bitmaps by number.
BITMAP_CODECS = {0: "uncompressed", 1: "rle", 2: "rle", 3: "bitfields", 4: "jpeg", 5: "flate", 6: "bitfields", 11: "uncompressed", 12: "rle", 13: "rle"}
#: Markers of frames.
SOF_MARKERS = frozenset((0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF))


class BadData(ValueError):
    """Bad data after some good: known has what was read before."""

    def __init__(self, known: dict) -> None:
        super().__init__("bad data")
        self.known = known


#: Bytes of a file that are held at a time, and digits of a number at most.
PIECE, DIGITS = 1 << 14, 4300


class FileBytes:
    """An open file's bytes by index or slice; one piece of it is held at a time."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.size, self.at, self.piece = file, os.fstat(file.fileno()).st_size, 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, key: int | slice) -> int | bytes:
        start, stop, _ = key.indices(self.size) if isinstance(key, slice) else (key, key + 1, 1)
        if start >= self.size and not isinstance(key, slice):
            raise IndexError(key)
        if start >= stop:
            return b""
        if start < self.at or stop > self.at + len(self.piece):
            self.file.seek(start)
            self.at, self.piece = start, self.file.read(max(PIECE, stop - start))
        return self.piece[start - self.at : stop - self.at] if isinstance(key, slice) else self.piece[start - self.at]


def _unpack(layout: str, data: bytes | FileBytes, at: int) -> tuple:
    return struct.unpack(layout, data[at : at + struct.calcsize(layout)])


def png(data: bytes | FileBytes) -> dict:
    """Dimensions of IHDR; a PNG with an animation control chunk before its image is an apng."""
    apple = data[12:16] == b"CgBI"
    at = 24 if apple else 8
    if data[at + 4 : at + 8] != b"IHDR" or len(data) < at + 16:
        raise ValueError("no IHDR")
    width, height = _unpack(">II", data, at + 8)
    out = {"format": "png", "codec": "flate", "width": width, "height": height}
    if apple:
        out["subformat"] = "apple"
    while at + 8 <= len(data):
        size, kind = _unpack(">I4s", data, at)
        if kind == b"acTL":
            out["format"] = "apng"
        if kind in (b"acTL", b"IDAT", b"IEND"):
            break
        at += 12 + size
    return out


def gif(data: bytes | FileBytes) -> dict:
    """Logical screen size; two image descriptors make an agif."""
    if len(data) < 10:
        raise ValueError("too short")
    width, height = _unpack("<HH", data, 6)
    out = {"format": "gif", "codec": "lzw", "width": width, "height": height}
    if len(data) < 13:
        return out
    at, images = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0), 0

    def after_blocks(at: int) -> int:
        while at < len(data) and data[at]:
            at += 1 + data[at]
        return at + 1

    while at < len(data):
        if data[at] == 0x21:
            at = after_blocks(at + 2)
        elif data[at] == 0x2C:
            images += 1
            if images == 2:
                out["format"] = "agif"
                break
            if at + 9 >= len(data):
                break
            at = after_blocks(at + 11 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 0x80 else 0))
        else:
            break
    return out


def jpeg(data: bytes | FileBytes) -> dict:
    """Dimensions of the first start-of-frame segment."""
    out, at = {"format": "jpeg", "codec": "jpeg"}, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        if data[at + 1] == 0xFF:
            at += 1
            continue
        marker, size = data[at + 1], _unpack(">H", data, at + 2)[0]
        if marker in SOF_MARKERS:
            if at + 9 > len(data):
                raise ValueError("start of frame cut off")
            out["height"], out["width"] = _unpack(">HH", data, at + 5)
            return out
        if marker in (0xD9, 0xDA) or size < 2:
            raise ValueError("no start of frame")
        at += 2 + size
    raise ValueError("no start of frame in the bytes read")


def bmp(data: bytes | FileBytes) -> dict:
    """Dimensions of the bitmap header of either kind, as the unsigned numbers that they are stored as."""
    if len(data) < 26:
        raise ValueError("too short")
    size = _unpack("<I", data, 14)[0]
    if 12 <= size < 40:
        width, height = _unpack("<HH", data, 18)
        return {"format": "bmp", "codec": "uncompressed", "width": width, "height": height}
    if not 40 <= size <= 127:
        raise ValueError("bad header size")
    width, height = _unpack("<II", data, 18)
    out = {"format": "bmp", "width": width, "height": height}
    if len(data) >= 34:
        number = _unpack("<I", data, 30)[0]
        out["codec"] = BITMAP_CODECS.get(number, str(number))
    return out


def wav(data: bytes | FileBytes) -> dict:
    """Parameters of the format chunk, wherever it stands."""
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], _unpack("<I", data, at + 4)[0]
        if kind == b"fmt ":
            if not 16 <= size <= 80 or at + 24 > len(data):
                raise ValueError("bad format chunk")
            form, channels, rate, _, _, bits = _unpack("<HHIIHH", data, at + 8)
            return {"format": "wav", "acodec": WAVE_CODECS.get(form, f"0x{form:x}"), "anch": channels, "arate": rate, "asbits": bits or 16}
        at += 8 + size + (size & 1)
    raise ValueError("no format chunk")


#: Fields of FLAC's stream information after its ten bytes of block and frame sizes: name, bits, and what is added.
FLAC_FIELDS = (("arate", 20, 0), ("anch", 3, 1), ("asbits", 5, 1))


def flac(data: bytes | FileBytes) -> dict:
    """The stream information, which is the first metadata block and has 34 bytes at least."""
    kind, size = data[4:5], int.from_bytes(data[5:8], "big")
    stream = data[18:26]
    if len(stream) < 8 or kind not in (b"\x00", b"\x80") or not 34 <= size < 256:
        raise ValueError("no stream information")
    out, bits = {"format": "flac", "acodec": "flac"}, "".join(f"{b:08b}" for b in stream)
    for name, width, more in FLAC_FIELDS:
        out[name], bits = int(bits[:width], 2) + more, bits[width:]
    return out


def au(data: bytes | FileBytes) -> dict:
    """Sun audio: all in one fixed header, with the codec by number."""
    if len(data) < 24:
        raise ValueError("too short")
    start, _, encoding, rate, channels = _unpack(">5I", data, 4)
    if not 24 <= start <= 255 or encoding not in SUN_CODECS or not 1 <= channels <= 16:
        raise ValueError("bad header")
    codec, bits = SUN_CODECS[encoding]
    out = {"format": "au", "acodec": codec, "anch": channels, "asbits": bits, "arate": rate}
    if not RATE_RANGE[0] <= rate <= RATE_RANGE[1]:
        raise BadData(out)
    return out


def extended(raw: bytes) -> Fraction:
    """The value of a normal 80-bit float: a sign bit, 15 bits of exponent with a bias of 16383, and a mantissa whose first bit, the units, is there."""
    head, mantissa = struct.unpack(">HQ", raw)
    sign, exponent = -1 if head >= 1 << 15 else 1, head % (1 << 15)
    if not 0 < exponent < (1 << 15) - 1 or mantissa < 1 << 63:
        raise ValueError("no normal number")
    return sign * Fraction(mantissa, 1 << 63) * Fraction(2) ** (exponent - 16383)


def rounded(x: Fraction) -> int:
    """The nearest integer; halves go away from zero."""
    return int(x + Fraction(1 if x > 0 else -1, 2))


def chunks(data: bytes | FileBytes, at: int, order: str = ">"):
    """(kind, first byte, size) of the chunks of an IFF or RIFF file from at on; chunks have even sizes."""
    while at + 8 <= len(data):
        kind, size = _unpack(order + "4sI", data, at)
        yield kind, at + 8, size
        at += 8 + size + size % 2


def aiff(data: bytes | FileBytes) -> dict:
    """The common chunk: channels, frames, bits of a sample, and the rate as an extended float; in AIFC also a codec."""
    compressed = data[8:12] == b"AIFC"
    out = {"format": "aifc"} if compressed else {"format": "aiff", "acodec": "pcm"}
    for kind, at, size in chunks(data, 12):
        common = data[at : at + 18]
        if kind != b"COMM" or size < 18 or len(common) < 18:
            continue
        if compressed:
            codec = data[at + 18 : at + 22]
            if not 23 <= size <= 255 or len(codec) < 4:
                raise BadData(out)
            name = codec.decode("latin-1").strip().lower()
            out["acodec"] = containers.MP4_AUDIO.get(name, name)
        for name, value, (low, high) in (("anch", lambda: _unpack(">H", common, 0)[0], CHANNEL_RANGE), ("arate", lambda: rounded(extended(common[8:])), RATE_RANGE), ("asbits", lambda: _unpack(">H", common, 6)[0], (1, 32))):
            try:
                found = value()
            except ValueError:
                raise BadData(out) from None
            if not low <= found <= high:
                raise BadData(out)
            out[name] = found
        break
    return out


def tiff(data: bytes | FileBytes) -> dict:
    """Dimensions and compression of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        raise ValueError("too short")
    at = _unpack(order + "I", data, 4)[0]
    out = {"format": "tiff"}
    if at + 2 > len(data):
        return out
    codecs = {1: "uncompressed", 2: "rle", 3: "fax", 4: "fax", 5: "lzw", 6: "jpeg", 7: "jpeg", 8: "flate", 32773: "rle", 32946: "flate"}
    for k in range(_unpack(order + "H", data, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(data):
            break
        tag, kind = _unpack(order + "HH", data, entry)
        value = _unpack(order + {1: "B", 3: "H", 4: "I"}.get(kind, "I"), data, entry + 8)[0]
        if tag == 256:
            out["width"] = value
        elif tag == 257:
            out["height"] = value
        elif tag == 259:
            out["codec"] = codecs.get(value, str(value))
    return out


def pnm(data: bytes | FileBytes) -> dict:
    """Text tokens of width and height, comments skipped."""
    kinds = {1: ("pbm", "uncompressed-ascii"), 2: ("pgm", "uncompressed-ascii"), 3: ("ppm", "uncompressed-ascii"), 4: ("pbm", "uncompressed"), 5: ("pgm", "uncompressed"), 6: ("ppm", "uncompressed"), 7: ("ppmx", "uncompressed")}
    subformat, codec = kinds.get(data[1] - 48, (None, None))
    if subformat is None:
        raise ValueError("bad kind")
    numbers, at = [], 2
    while len(numbers) < 2:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                while at < len(data) and data[at : at + 1] not in (b"\n", b"\r"):
                    at += 1
            else:
                at += 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
            if end - at > DIGITS:
                raise ValueError("number too long")
        if end == at or end == len(data):
            raise ValueError("number expected")
        numbers.append(int(data[at:end]))
        at = end
    return {"format": "pnm", "subformat": subformat, "codec": codec, "width": numbers[0], "height": numbers[1]}


WALKERS: dict[str, Callable[[bytes | FileBytes], dict]] = {"png": png, "gif": gif, "jpeg": jpeg, "bmp": bmp, "wav": wav, "flac": flac, "au": au, "aiff": aiff, "aifc": aiff, "tiff": tiff, "pnm": pnm} | containers.WALKERS | pictures.WALKERS


def walked(files: DataFrame, content: str = "content", name: str | None = None, limit: int = 0) -> DataFrame:
    """files (with format) with the walkers' values appended, own columns of these names replaced; format as the walker refines it.

    error is bad_data where a walker refuses the bytes or a number is beyond 64 bits, which is then null. Formats without a walker keep their format and have
    nulls, as have null contents. Where name has the files' names, contents of limit bytes or more may be only their
    beginnings: walkers then read and seek in the file itself. One that can't be read then has error bad_open.
    """
    kept = [f for f in files.schema.fields if f.name not in NAMES]
    schema = StructType([*kept, *(StructField(n, t) for n, t in NAMES.items())])

    def run(it):
        for batch in it:
            rows = []
            files = batch.column(name).to_pylist() if name else [None] * batch.num_rows
            for data, kind, file in zip(batch.column(content), batch.column("format").to_pylist(), files):
                data, walker, out = data.as_py(), WALKERS.get(kind), {"format": kind}
                if walker and data is not None:
                    try:
                        if file is not None and len(data) >= limit:
                            with open(file, "rb") as f:
                                out |= walker(FileBytes(f))
                        else:
                            out |= walker(data)
                        out |= containers.rolled(out.pop("tracks", []))
                        if any(isinstance(v, int) and v >= 1 << 63 for v in out.values()):
                            raise BadData({k: None if isinstance(v, int) and v >= 1 << 63 else v for k, v in out.items()})
                    except OSError:
                        out["error"] = "bad_open"
                    except BadData as e:
                        out |= e.known | {"error": "bad_data"}
                    except (ValueError, struct.error, IndexError, RecursionError):
                        out["error"] = "bad_data"
                rows.append(out)
            added = [pa.array([r.get(n) for r in rows], pa.int64() if isinstance(t, LongType) else pa.string()) for n, t in NAMES.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *added], names=schema.names)

    return files.mapInArrow(run, schema)
