"""Media parameters of pictures, drawings, animations and programs whose headers are short: one table of places, and a walker for each header that needs more.

Walkers have the form of those in walkers.py. Numbers that a file is too short for are left out; what contradicts the format raises ValueError.
"""

from __future__ import annotations

import lzma
import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from fathomline.analyzers.containers import MP4_VIDEO, RIFF_VIDEO


@dataclass(frozen=True)
class Picture:
    """Width and height by a struct layout at an offset (the other way round: swapped), a codec that does not vary, and, for formats of both byte orders, the first bytes of little-endian files."""

    at: int
    layout: str
    codec: str | None = None
    swapped: bool = False
    little: bytes | None = None


# Where formats keep their dimensions.
PICTURES = {
    "alias-pix": Picture(0, ">HH", "rle"),
    "cineon": Picture(200, ">II", "uncompressed", little=b"\xd7\x5f\x2a\x80"),
    "cmuwm": Picture(4, ">II", "uncompressed", little=b"\xbb\x40\0\xf1"),
    "deep": Picture(20, ">HH"),
    "dpx": Picture(772, ">II"),
    "fif": Picture(6, "<II", "fractal"),
    "jpc": Picture(8, ">II", "jpeg2000"),
    "lbm": Picture(20, ">HH"),
    "minolta-raw": Picture(28, ">HH", "raw", swapped=True),
    "pcpaint-pic": Picture(2, "<HH", "rle"),
    "utah-rle": Picture(6, "<HH", "rle"),
    "xcf": Picture(14, ">II"),
    "xloadimage-niff": Picture(8, ">II", "uncompressed"),
    "xv-pm": Picture(8, ">II", "uncompressed", swapped=True, little=b"WEIV"),
    "ybm": Picture(2, ">HH", "uncompressed"),
}
# Codecs by number.
DEEP_CODECS = ("uncompressed", "rle", "huffman", "dynamic-huffman", "jpeg", "tvdc")
DPX_CODECS = ("uncompressed", "rle")
PSP_CODECS = ("uncompressed", "rle", "lz77", "jpeg")
MIFF_CODECS = {"none": "uncompressed", "bzip": "bzip2", "zip": "flate"}
SWF_CODECS = {b"F": "uncompressed", b"C": "flate", b"Z": "lzma"}
# What stands before the dimensions of two kinds of ART files, and before those with the height first.
ART_WIDE = (b"\4\0\7\0\x40\x15\3", b"\4\0\7\0\x40\x15\x20")
ART_HIGH = (b"\3\4\x8e\2\x0a\0", b"\4\0\x8c\x16\0\0")
#: Bytes of a text header at most: a longer one is bad data.
HEADER = 1 << 20


def _read(data, layout: str, at: int) -> tuple | None:
    raw = data[at : at + struct.calcsize(layout)]
    return struct.unpack(layout, raw) if len(raw) == struct.calcsize(layout) else None


def _need(holds: object, what: str) -> None:
    if not holds:
        raise ValueError(f"bad {what}")


def _header(data, end: bytes, start: int = 0) -> bytes:
    """What stands from start up to the first `end`, looked for in growing pieces."""
    size = 1 << 12
    while size <= HEADER:
        head, found, _ = data[start : start + size].partition(end)
        if found:
            return head
        if len(head) < size:
            break
        size *= 4
    raise ValueError("header without end")


def _named(number: int, names: tuple[str, ...]) -> str:
    return names[number] if number < len(names) else str(number)


def _placed(name: str, picture: Picture) -> Callable[..., dict]:
    def walk(data) -> dict:
        out = {"format": name} | ({"codec": picture.codec} if picture.codec else {})
        layout = picture.layout
        if picture.little and data[: len(picture.little)] == picture.little:
            layout = layout.replace(">", "<")
        if size := _read(data, layout, picture.at):
            out |= dict(zip(("height", "width") if picture.swapped else ("width", "height"), size))
        return out

    return walk


def _refined(name: str, more: Callable[..., dict]) -> Callable[..., dict]:
    """The table's values and those that more finds."""
    base = _placed(name, PICTURES[name])
    return lambda data: base(data) | more(data)


def _deep(data) -> dict:
    found = _read(data, ">H", 24)
    return {"codec": _named(found[0], DEEP_CODECS)} if found else {}


def _dpx(data) -> dict:
    found = _read(data, ">H", 806)
    return {"codec": DPX_CODECS[found[0]]} if found and found[0] < len(DPX_CODECS) else {}


def _lbm(data) -> dict:
    kind = data[8:12]
    return {"subformat": kind.decode("latin-1").strip().lower(), "codec": "rle" if kind[:1] == b"I" else "uncompressed"}


def _utah_rle(data) -> dict:
    if found := _read(data, "<5B", 10):
        flags, colors, bits, maps, length = found
        _need(flags < 16 and 1 <= colors <= 5 and bits == 8 and maps <= 5 and length <= 8, "parameters")
    return {}


def _xv_pm(data) -> dict:
    components, _, _, bands, kind = _read(data, "<5I" if data[:4] == b"WEIV" else ">5I", 4) or (0,) * 5
    _need(bands == 1 and (kind, components) in ((0x8001, 1), (0x8001, 3), (0x8001, 4), (0x8004, 1)), "parameters")
    return {}


def art(data) -> dict:
    out, kind = {"format": "art", "codec": "art"}, data[2:3]
    if kind + data[7:13] in ART_WIDE:
        size, names = _read(data, "<HH", 13), ("width", "height")
    elif kind + data[7:12] in ART_HIGH:
        size, names = _read(data, "<HH", 12), ("height", "width")
    else:
        return out
    return out | dict(zip(names, size or ()))


def fbm(data) -> dict:
    """Dimensions as digits in eight bytes each."""
    out = {"format": "fbm", "codec": "uncompressed"}
    if len(data) >= 24:
        out |= {name: int(data[at : at + 8].split(b"\0")[0]) for name, at in (("width", 8), ("height", 16))}
    return out


def macpaint(data) -> dict:
    """All have one size."""
    return {"format": "macpaint", "codec": "rle", "width": 576, "height": 720}


def psp(data) -> dict:
    out = {"format": "psp"}
    if len(data) >= 58:
        major, minor, mark, tag, first, second, width, height = struct.unpack("<HH4sHIIII", data[32:58])
        _need(mark == b"~BK\0" and tag == 0 and first == second and first >= 8, "block")
        out |= {"width": width, "height": height}
        _need(1 <= major <= 8 and minor <= 20, "version")
        if found := _read(data, "<H", 67):
            out["codec"] = _named(found[0], PSP_CODECS)
    return out


def _varint(data, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, most significant first, and where it ends."""
    value = 0
    for k in range(9):
        byte = data[at + k]
        value = value << 7 | byte & 127
        if byte < 128:
            return value, at + k + 1
    raise ValueError("number too long")


def flif(data) -> dict:
    _need(data[4] >> 4 in (3, 4, 5, 6) and data[4] & 15 in (1, 3, 4) and data[5] in b"012", "parameters")
    width, at = _varint(data, 6)
    return {"format": "flif", "codec": "flif", "width": width + 1, "height": _varint(data, at)[0] + 1}


def fuif(data) -> dict:
    _need(0x31 <= data[4] <= 0x35 and 1 <= data[5] - 0x26 <= 16, "parameters")
    width, at = _varint(data, 6)
    return {"format": "fuif", "subformat": "fuaf" if data[:4] == b"FUAF" else "fuif", "codec": "fuif", "width": width + 1, "height": _varint(data, at)[0] + 1}


def djvu(data) -> dict:
    """A page's INFO chunk; in a document of several pages that of the first one in it."""
    out = {"format": "djvu", "subformat": "djvu" if data[15:16] == b"U" else "djvm"}
    at = 16
    if out["subformat"] == "djvm":
        end = 12 + struct.unpack(">I", data[8:12])[0]
        while True:
            head = _read(data, ">4sI", at)
            _need(head and at + 8 + head[1] <= end, "member")
            if head[0] == b"FORM" and data[at + 8 : at + 12] == b"DJVU":
                at += 12
                break
            at += 8 + head[1]
    info = _read(data, ">4sIHH", at)
    _need(info and info[0] == b"INFO" and 4 <= info[1] < 256, "INFO")
    return out | {"width": info[2], "height": info[3]}


def miff(data) -> dict:
    """`key=value` words up to a colon and a control character."""
    out = {"format": "miff", "codec": "uncompressed"}
    for word in _header(data, b":\x1a").decode("latin-1").split():
        key, equals, value = word.partition("=")
        if equals and key.lower() == "compression":
            out["codec"] = MIFF_CODECS.get(value.lower(), value.lower())
        elif equals and key.lower() in ("columns", "rows"):
            _need(value.isdigit() and int(value) > 0, key)
            out["width" if key.lower() == "columns" else "height"] = int(value)
    return out


def vicar(data) -> dict:
    """Samples and lines of a label of `KEY=value` items, quoted values apart."""
    size = re.match(rb"LBLSIZE=(\d{2,9})\s", data[:64])
    _need(size, "label size")
    label = data[: min(int(size[1]), HEADER)]
    _need(len(label) == int(size[1]), "label")
    items = dict(re.findall(r"(\w+)\s*=\s*(?:'[^']*'|([^\s']+))", label.split(b"\0")[0].decode("latin-1")))
    out = {"format": "vicar"}
    if items.get("NS") and items.get("NL"):
        out |= {"width": int(items["NS"]), "height": int(items["NL"])}
    return out


def sun_taac(data) -> dict:
    """`key=value;` lines up to a form feed."""
    out = {"format": "sun-taac", "codec": "uncompressed"}
    if len(data) <= 6:
        return out
    head, found, _ = data[4:2048].replace(b"\r", b"\n").partition(b"\f\n")
    _need(found, "header")
    for line in re.split(r"[;\n]", head.decode("latin-1")):
        key, equals, value = (part.strip() for part in line.partition("="))
        _need(not line.strip() or equals and re.fullmatch("[a-z]+", key), "line")
        if key == "size":
            width, height = value.split()
            out |= {"width": int(width), "height": int(height)}
    return out


def xpm(data) -> dict:
    """Versions 2 and 3: the first two numbers, in version 3 of the first string."""
    head = data[: 1 << 16].decode("latin-1")
    out = {"format": "xpm", "subformat": "xpm2" if head.startswith("! XPM2") else "xpm3", "codec": "uncompressed-ascii"}
    rest = head[7:] if out["subformat"] == "xpm2" else head[10:]
    if rest.strip("\r\n\t "):
        size = re.match(r"[\r\n\t ]*(\d{1,18})[\r\n\t ]+(\d{1,18})[\r\n\t ]" if out["subformat"] == "xpm2" else r'[^"]*"(\d{1,18})[\r\n\t ]+(\d{1,18})[\r\n\t ]', rest)
        _need(size, "dimensions")
        out |= {"width": int(size[1]), "height": int(size[2])}
    return out


def xwd(data) -> dict:
    """Dumps of versions 6 (X10) and 7 (X11), in either byte order."""
    order = ">" if data[4:7] == b"\0\0\0" else "<"
    size, version = _read(data, order + "II", 0) or (0, 0)
    _need(28 <= size <= 512 and version in (6, 7) and len(data) >= (20 if version == 6 else 16), "header")
    out, values = {"format": "xwd", "subformat": "x10" if version == 6 else "x11"}, _read(data, order + "5I", 8)
    if version == 6:
        display, planes, pixmap = _read(data, order + "3I", 8)
        _need(display <= 16 and 1 <= planes <= 5 and pixmap <= 1, "parameters")
        return out | (dict(zip(("width", "height"), values[3:])) if values else {})
    pixmap, depth = _read(data, order + "2I", 8)
    _need(pixmap <= 2 and 1 <= depth <= 32, "parameters")
    return out | (dict(zip(("width", "height"), values[2:4])) if values else {})


def qtif(data) -> dict:
    """The image description among the atoms."""
    at = 0
    while head := _read(data, ">I4s", at):
        if head[1] == b"idsc":
            codec, width, height = _read(data, ">4s", at + 12), *(_read(data, ">HH", at + 40) or (None, None))
            _need(codec and height is not None, "description")
            name = codec[0].decode("latin-1").strip().lower()
            return {"format": "qtif", "codec": MP4_VIDEO.get(name, name), "width": width, "height": height}
        _need(head[0] >= 8, "atom")
        at += head[0]
    return {"format": "qtif"}


def _points(low: int, high: int, unit: int) -> int:
    """A length in points, of `unit` to an inch, rounded."""
    return (abs(high - low) * 72 + unit // 2) // unit


def emf(data) -> dict:
    """The frame, in hundredths of a millimetre; EMF+ records follow the header."""
    found = _read(data, "<I16x4i", 4)
    _need(len(data) >= 60 and found and 88 <= found[0] < 256 and found[0] % 4 == 0, "header")
    size, left, top, right, bottom = found
    out = {"format": "emf", "subformat": "emf", "width": _points(left, right, 2540), "height": _points(top, bottom, 2540)}
    if data[size : size + 4] == b"F\0\0\0" and data[size + 12 : size + 18] == b"EMF+\1@" and (flags := _read(data, "<H", size + 18)):
        out["subformat"] = "dual" if flags[0] & 1 else "emfplus"
    return out


def wmf(data) -> dict:
    """The placeable header's box; files without one have no size."""
    out = {"format": "wmf"}
    if data[:6] == b"\xd7\xcd\xc6\x9a\0\0" and (found := _read(data, "<5HI", 6)):
        left, top, right, bottom, unit, reserved = found
        _need(unit and not reserved, "header")
        out |= {"width": _points(left, right, unit), "height": _points(top, bottom, unit)}
    return out


def swf(data) -> dict:
    """The frame's rectangle in twentieths, in what may be compressed."""
    codec, version = SWF_CODECS.get(data[:1]), data[3]
    _need(codec and version >= {"uncompressed": 1, "flate": 6, "lzma": 13}[codec], "version")
    out = {"format": "swf", "codec": codec}
    if codec == "lzma":
        properties = data[12]
        chain = {"id": lzma.FILTER_LZMA1, "lc": properties % 9, "lp": properties // 9 % 5, "pb": properties // 45, "dict_size": 4096}
        try:
            body = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[chain]).decompress(data[17:290], 17)
        except lzma.LZMAError as e:
            raise ValueError("bad stream") from e
    elif codec == "flate":
        try:
            body = zlib.decompressobj().decompress(data[8:281], 17)
        except zlib.error as e:
            raise ValueError("bad stream") from e
    else:
        body = data[8:25]
    bits = "".join(f"{b:08b}" for b in body[:17])
    width = int(bits[:5] or "0", 2)
    _need(width and len(bits) >= 5 + 4 * width, "rectangle")
    left, right, top, bottom = (int(bits[5 + k * width : 5 + (k + 1) * width], 2) for k in range(4))
    _need(left <= right and top <= bottom, "rectangle")
    return out | {"width": (right - left + 10) // 20, "height": (bottom - top + 10) // 20}


def yuv4mpeg2(data) -> dict:
    """A line of tags, a letter and its value each."""
    words = _header(data, b"\n", 10).decode("latin-1").split(" ")
    _need(all(re.match("[A-Z]", w) for w in words) and len({w[0] for w in words}) == len(words), "header")
    tags = {w[0]: w[1:] for w in words}
    _need(tags.get("W", "").isdigit() and tags.get("H", "").isdigit(), "dimensions")
    return {"format": "yuv4mpeg2", "tracks": [{"type": "video", "codec": "uncompressed", "width": int(tags["W"]), "height": int(tags["H"])}]}


def ani(data) -> dict:
    """The first icon of an animated cursor."""
    at, out = 12, {"format": "ani"}
    while head := _read(data, "<4sI", at):
        kind, size = head
        if kind == b"LIST" and data[at + 8 : at + 12] == b"fram":
            if icon := _read(data, "<4sIHHHBB", at + 12):
                _need(icon[0] == b"icon" and icon[1] >= 10 and not icon[2] and icon[3] in (1, 2) and icon[4] == 1, "icon")
                out["tracks"] = [{"type": "video", "codec": "uncompressed", "width": icon[5] or 256, "height": icon[6] or 256}]
            break
        _need(kind in (b"LIST", b"anih", b"seq ", b"rate"), "chunk")
        if kind == b"anih" and (shape := _read(data, "<9I", at + 8)) and not shape[8] & 1:
            out["tracks"] = [{"type": "video", "codec": "uncompressed", "width": shape[3], "height": shape[4]}]
            break
        at += 8 + size + size % 2
    return out


# Identifiers of ASF objects and stream types.
ASF_STREAM = bytes.fromhex("9107dcb7b7a9cf118ee600c00c205365")
ASF_AUDIO = bytes.fromhex("409e69f84d5bcf11a8fd00805f5c442b")
ASF_VIDEO = bytes.fromhex("c0ef19bc4d5bcf11a8fd00805f5c442b")


def asf(data) -> dict:
    """Stream properties among the header's objects."""
    from fathomline.analyzers.walkers import BITMAP_CODECS, WAVE_CODECS

    head = _read(data, "<16sQIH", 0)
    _need(head and head[1] >= 30 and head[3] == 0x201, "header")
    at, tracks = 30, []
    for _ in range(head[2]):
        if at >= head[1]:
            break
        found = _read(data, "<16sQ", at)
        _need(found and 24 <= found[1] <= head[1] - at, "object")
        if found[0] == ASF_STREAM:
            kind, at_type = data[at + 24 : at + 40], at + 78
            if kind == ASF_AUDIO:
                form, channels, rate, bits = _read(data, "<HHI6xH", at_type) or (None,) * 4
                _need(form is not None, "audio stream")
                tracks.append({"type": "audio", "codec": WAVE_CODECS.get(form, f"0x{form:x}"), "anch": channels, "arate": rate, "asbits": bits or 16})
            elif kind == ASF_VIDEO:
                width, height, code = _read(data, "<II19x4s", at_type) or (None,) * 3
                _need(code is not None and (width, height) == _read(data, "<II", at_type + 15), "video stream")
                number, name = int.from_bytes(code, "little"), code.decode("latin-1").strip().lower()
                tracks.append({"type": "video", "codec": BITMAP_CODECS.get(number, str(number)) if number < 32 else "mpeg" if number in (0x10000001, 0x10000002) else RIFF_VIDEO.get(name, name), "width": width, "height": height})
        at += found[1]
    kinds = {t["type"] for t in tracks}
    return {"format": "wmv" if "video" in kinds else "wma" if kinds else "asf", "tracks": tracks}


def ape(data) -> dict:
    """Channels and rate, whose place depends on the version."""
    version = struct.unpack("<H", data[4:6])[0]
    at = 10
    if version > 3979:
        size = struct.unpack("<H", data[8:10])[0]
        _need(size >= 10, "header")
        at = size + 18
    found = _read(data, "<HI", at)
    _need(found, "parameters")
    return {"format": "ape", "tracks": [{"type": "audio", "codec": "ape", "asbits": 16, "anch": found[0], "arate": found[1]}]}


def oggpcm(data) -> dict:
    """Kind of samples, rate and channels of a PCM stream of Ogg."""
    major, minor, kind, rate, bits, channels = struct.unpack(">HHIIBB", data[8:22])
    _need(major == 0 and minor < 256, "version")
    codec, size = "unknown", bits
    if kind < 8:
        codec, size = "pcm", (kind // 2 + 1) * 8
    elif kind in (16, 17):
        codec, size = ("mulaw", "alaw")[kind - 16], 8
    elif 32 <= kind < 36:
        codec, size = "float", (kind // 2 - 15) * 32
    if codec != "float" and 0 < bits < size:
        size = bits
    return {"format": "oggpcm", "tracks": [{"type": "audio", "codec": codec, "arate": rate, "anch": channels, "asbits": size}]}


def wasm(data) -> dict:
    return {"format": "wasm", "subformat": "binary" if data[:1] == b"\0" else "ascii"}


def elf(data) -> dict:
    """Word size; class and byte order must be those that exist."""
    _need(len(data) >= 24 and data[4] in (1, 2) and data[5] in (1, 2), "class")
    return {"format": "elf", "subformat": "32bit" if data[4] == 1 else "64bit"}


def luac(data) -> dict:
    return {"format": "lua-luac", "subformat": f"{data[4] >> 4}.{data[4] & 15}"}


WALKERS = {name: _placed(name, picture) for name, picture in PICTURES.items()} | {
    "deep": _refined("deep", _deep), "dpx": _refined("dpx", _dpx), "lbm": _refined("lbm", _lbm), "utah-rle": _refined("utah-rle", _utah_rle), "xv-pm": _refined("xv-pm", _xv_pm),
    "ani": ani, "ape": ape, "art": art, "asf": asf, "djvu": djvu, "elf": elf, "emf": emf, "fbm": fbm, "flif": flif, "fuif": fuif, "lua-luac": luac, "macpaint": macpaint, "miff": miff,
    "oggpcm": oggpcm, "psp": psp, "qtif": qtif, "sun-taac": sun_taac, "swf": swf, "vicar": vicar, "wasm": wasm, "wmf": wmf, "xpm": xpm, "xwd": xwd, "yuv4mpeg2": yuv4mpeg2,
}
