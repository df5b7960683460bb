"""Media parameters of containers and streams: tracks found by walking boxes, elements, chunks, pages and tags.

Walkers have the form of those in walkers.py. Where a file has tracks they give a list of them under `tracks`, which
rolled() turns into the row of the file; payloads are skipped, never read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Codecs by sample entry of ISO media files, in lower case without spaces.
MP4_VIDEO = {
    "avc1": "h264", "h264": "h264", "mp4v": "divx5", "mp4s": "divx5", "rv60": "rv6", "s263": "h263", "mjp2": "mjpeg2000", "mjpa": "mjpeg", "mjpb": "mjpeg", "mjpg": "mjpeg",
    "svq1": "sorenson1", "svq3": "sorenson3", "mpgv": "mpeg2", "div1": "divx", "divx": "divx", "xvid": "divx", "dx50": "divx5", "fmp4": "divx5", "dvav": "h264", "dvhc": "h265",
    "hev1": "h265", "hvc1": "h265", "av01": "av1", "vc-1": "vc1", "vp03": "vp3", "vp04": "vp4", "vp05": "vp5", "vp06": "vp6", "vp07": "vp7", "vp08": "vp8", "vp09": "vp9",
    "vp10": "vp10", "vp11": "vp11", "jpeg": "jpeg", "kpcd": "photocd",
}
MP4_AUDIO = {
    "raw": "pcm", "sowt": "pcm", "twos": "pcm", "in24": "pcm", "in32": "pcm", "fl32": "pcm", "fl64": "pcm", "none": "pcm", "pcm": "pcm", "alaw": "alaw", "ulaw": "mulaw", "ace2": "ace2",
    "ace8": "ace8", "mac3": "mac3", "mac6": "mac6", ".mp3": "mp3", "mp3": "mp3", "mp4a": "mp4a", "mp4s": "mp4a", "samr": "samr", "mpga": "mp2", "sawb": "sawb", "dts+": "dts",
    "dts-": "dts", "dtsc": "dts", "dtse": "dts", "dtsh": "dts", "dtsl": "dts", "dtsx": "dts", "ac-3": "ac3", "ec-3": "enhanced-ac3", "ac-4": "ac4",
}
# Codecs by Matroska codec id.
MATROSKA = {
    "V_UNCOMPRESSED": "pcm", "V_MPEG4/ISO/SP": "divx4", "V_MPEG4/ISO/ASP": "divx5", "V_MPEG4/ISO/AVC": "h264", "V_MPEG4/ISO/HEVC": "h265", "V_MPEG4/MS/V3": "divx3", "V_MPEGH/ISO/HEVC": "h265",
    "V_MPEG1": "mpeg1", "V_MPEG2": "mpeg2", "V_REAL/RV10": "rv5", "V_REAL/RV20": "rvg2", "V_REAL/RV30": "rv9", "V_QUICKTIME": "qt", "V_THEORA": "theora", "V_DAALA": "daala", "V_PRORES": "prores",
    "V_VP3": "vp3", "V_VP4": "vp4", "V_VP5": "vp5", "V_VP6": "vp6", "V_VP7": "vp7", "V_VP8": "vp8", "V_VP9": "vp9", "V_VP10": "vp10", "V_VP11": "vp11", "A_MPEG/L3": "mp3", "A_MPEG/L2": "mp2",
    "A_MPEG/L1": "mp1", "A_PCM/INT/BIG": "pcm", "A_PCM/INT/LIT": "pcm", "A_PCM/FLOAT/IEEE": "pcm", "A_MPC": "mpc", "A_AC3": "ac3", "A_EC3": "eac3", "A_TRUEHD": "truehd", "A_ALAC": "alac",
    "A_DTS": "dts", "A_DTS/EXPRESS": "dts-express", "A_DTS/LOSSLESS": "dts-lossless", "A_VORBIS": "vorbis", "A_FLAC": "flac",
}
# Codecs by the four characters of a RIFF video stream, in lower case.
RIFF_VIDEO = {
    "avc1": "h264", "dx50": "divx5", "fmp4": "divx5", "mpg4": "divx5", "mp42": "divx5", "divx": "divx", "div3": "divx", "div4": "divx", "dvx4": "divx", "3iv2": "divx", "h264": "h264",
    "x264": "h264", "xvid": "divx", "mjpg": "mjpeg", "msvc": "msvc", "cram": "msvc", "h265": "h265", "x265": "h265", "iv50": "indeo5", "iv41": "indeo4", "dvsd": "dv", "dvsl": "dv", "dvhd": "dv", "mpeg": "mpeg",
}
#: Boxes of ISO media files that hold boxes.
BOXES = frozenset(["moov", "trak", "mdia", "minf", "stbl"])
#: Elements of Matroska files that hold elements on the way to the tracks.
SEGMENT, TRACKS, ENTRY, VIDEO, AUDIO = 0x18538067, 0x1654AE6B, 0xAE, 0xE0, 0xE1
CLUSTER = 0x1F43B675
#: Tracks, images and pages of a file that are looked at; the formats themselves allow no more tracks than this.
MOST = 1 << 14


def rolled(tracks: list[dict]) -> dict:
    """The file's values, as operators.tracks.roll_up gives them from rows: one audio track gives all it has, several one known codec or `multiple`; video tracks of one size count as the first."""
    audio, video, out = [t for t in tracks if t["type"] == "audio"], [t for t in tracks if t["type"] == "video"], {}

    def one(found: list[dict], none: str) -> str:
        codecs = {t["codec"] for t in found if t.get("codec")}
        return codecs.pop() if len(codecs) == 1 else "multiple" if codecs else none

    if len(audio) == 1:
        out = {"acodec": audio[0].get("codec") or "?"} | {k: audio[0].get(k) for k in ("anch", "arate", "asbits")}
    elif audio:
        out["acodec"] = one(audio, "multiple")
    if len({(t.get("width"), t.get("height")) for t in video}) == 1:
        out |= {"vcodec": video[0].get("codec") or "?", "width": video[0].get("width"), "height": video[0].get("height")}
    elif video:
        out["vcodec"] = one(video, "?")
    return out


def _number(data, at: int, size: int, order: str = "big") -> int:
    raw = data[at : at + size]
    if len(raw) < size:
        raise ValueError("cut off")
    return int.from_bytes(raw, order)


def _tracked(kind: str, tracks: list[dict], **more) -> dict:
    return {"format": kind, "tracks": tracks, **more}


def boxes(data, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(type, first byte, byte after the last) of the boxes of an ISO media file between two places; a size of 0 goes on to the end."""
    while at + 8 <= end:
        size, kind, head = _number(data, at, 4), data[at + 4 : at + 8].decode("latin-1"), 8
        if size == 1:
            size, head = _number(data, at + 8, 8), 16
        stop = end if size == 0 else at + size
        if size and size < head:
            raise ValueError("box smaller than its head")
        yield kind, at + head, min(stop, end)
        at = stop


def mov(data) -> dict:
    """Brands, and a track for each sample description of video or audio."""
    out, tracks, handler = {"format": "mov"}, [], [""]

    def walk(at: int, end: int) -> None:
        for kind, start, stop in boxes(data, at, end):
            if kind == "ftyp" and stop - start >= 8:
                major = data[start : start + 4].decode("latin-1")
                brands = {major, *(data[k : k + 4].decode("latin-1") for k in range(start + 8, stop - 3, 4))}
                named = {"qt  ": "mov", "f4v ": "f4v", "jp2 ": "jp2", "jpm ": "jp2", "jpx ": "jp2", "mif1": "isobmff-image"}
                out["format"] = named.get(major) or ("isobmff-image" if "mif1" in brands else "mp4")
                out["subformat"] = major.strip()
            elif kind in BOXES:
                walk(start, stop)
            elif kind == "hdlr" and stop - start >= 12:
                found = data[start + 8 : start + 12].decode("latin-1")
                handler[0] = found if found in ("vide", "soun") else handler[0] if found in ("url ", "alis") else ""
            elif kind == "stsd" and handler[0]:
                for entry, first, last in list(boxes(data, start + 8, stop))[:MOST]:
                    name = entry.strip().lower()
                    if handler[0] == "vide":
                        size = {"width": _number(data, first + 24, 2), "height": _number(data, first + 26, 2)} if last - first >= 28 else {}
                        tracks.append({"type": "video", "codec": MP4_VIDEO.get(name, name), **size})
                    elif last - first >= 28:
                        tracks.append({"type": "audio", "codec": MP4_AUDIO.get(name, name), "anch": _number(data, first + 16, 2), "asbits": _number(data, first + 18, 2), "arate": _number(data, first + 24, 2)})
                handler[0] = ""

    walk(0, len(data))
    return out | {"tracks": tracks}


def _vint(data, at: int, keep: bool) -> tuple[int, int]:
    """(value, place after it) of an EBML number whose first set bit tells its bytes; keep: with that bit, as ids have it."""
    first = _number(data, at, 1)
    size = 9 - first.bit_length()
    if size > 8:
        raise ValueError("bad number")
    value = _number(data, at, size)
    return (value if keep else value & ((1 << 7 * size) - 1)), at + size


def elements(data, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, byte after the last) of EBML elements; one of unknown size goes on to the end."""
    while at < end:
        kind, at = _vint(data, at, True)
        before = at
        size, at = _vint(data, at, False)
        stop = end if size == (1 << 7 * (at - before)) - 1 else at + size
        yield kind, at, min(stop, end)
        at = stop


def mkv(data) -> dict:
    """Document type, and the tracks' codecs, sizes and sampling; nothing after the first cluster is looked at."""
    out, tracks = {"format": "mkv"}, []

    def number(a: int, b: int) -> int:
        return _number(data, a, b - a)

    def real(a: int, b: int) -> float:
        return struct.unpack({4: ">f", 8: ">d"}[b - a], data[a:b])[0] if b - a in (4, 8) else 0.0

    def entry(a: int, b: int) -> None:
        track: dict = {}
        for kind, x, y in elements(data, a, b):
            if kind == 0x83:
                track["type"] = {1: "video", 2: "audio"}.get(number(x, y), "other")
            elif kind == 0x86:
                name = data[x:y].decode("latin-1").rstrip("\0")
                track["codec"] = MATROSKA.get(name, "aac" if name.startswith("A_AAC") else name.partition("_")[2].lower() or name)
            elif kind == VIDEO:
                track |= {{0xB0: "width", 0xBA: "height"}[k]: number(p, q) for k, p, q in elements(data, x, y) if k in (0xB0, 0xBA)}
            elif kind == AUDIO:
                track |= {"anch": 1} | {{0x9F: "anch", 0x6264: "asbits"}[k]: number(p, q) for k, p, q in elements(data, x, y) if k in (0x9F, 0x6264)}
                track |= {"arate": round(real(p, q)) for k, p, q in elements(data, x, y) if k == 0xB5}
        if track.get("type") in ("video", "audio"):
            tracks.append(track)

    for kind, a, b in elements(data, 0, len(data)):
        if kind == 0x1A45DFA3:
            for k, x, y in elements(data, a, b):
                if k == 0x4282 and data[x:y].rstrip(b"\0") == b"webm":
                    out["format"] = "webm"
        elif kind == SEGMENT:
            for k, x, y in elements(data, a, b):
                if k == TRACKS:
                    for e, p, q in elements(data, x, y):
                        if e == ENTRY:
                            entry(p, q)
                if k == CLUSTER or k == TRACKS and tracks:
                    break
            break
    return out | {"tracks": tracks}


def avi(data) -> dict:
    """The stream headers and formats in the header list."""
    from fathomline.analyzers.walkers import WAVE_CODECS, chunks

    tracks: list[dict] = []

    def walk(at: int, end: int, inside: str) -> None:
        kind = ""
        for name, start, size in chunks(data, at, "<"):
            if start > end:
                break
            if name == b"LIST" and data[start : start + 4] in (b"hdrl", b"strl"):
                walk(start + 4, min(end, start + size), data[start : start + 4].decode())
            elif name == b"LIST" and data[start : start + 4] == b"movi":
                break
            elif inside == "strl" and name == b"strh":
                kind = data[start : start + 4].decode("latin-1")
                code = data[start + 4 : start + 8].decode("latin-1").strip("\0 ").lower()
                if kind == "vids":
                    tracks.append({"type": "video", "codec": RIFF_VIDEO.get(code, code)})
                elif kind == "auds":
                    tracks.append({"type": "audio"})
            elif inside == "strl" and name == b"strf" and tracks:
                if kind == "vids" and size >= 40:
                    code = data[start + 16 : start + 20].decode("latin-1").strip("\0 ").lower()
                    tracks[-1] |= {"width": _number(data, start + 4, 4, "little"), "height": abs(struct.unpack("<i", data[start + 8 : start + 12])[0])}
                    tracks[-1]["codec"] = RIFF_VIDEO.get(code, code) or tracks[-1]["codec"] or "uncompressed"
                elif kind == "auds" and size >= 16:
                    form, anch, rate, _, _, bits = struct.unpack("<HHIIHH", data[start : start + 16])
                    tracks[-1] |= {"codec": WAVE_CODECS.get(form, f"0x{form:x}"), "anch": anch, "arate": rate, "asbits": bits or 16}

    walk(12, len(data), "")
    return _tracked("avi", tracks)


def _audio_packet(raw: bytes) -> dict | None:
    """A track from the first packet of an Ogg stream, or None."""
    if raw[:7] == b"\x01vorbis" and len(raw) >= 16:
        return {"type": "audio", "codec": "vorbis", "anch": raw[11], "arate": _number(raw, 12, 4, "little"), "asbits": 16}
    if raw[:8] == b"OpusHead" and len(raw) >= 16:
        return {"type": "audio", "codec": "opus", "anch": raw[9], "arate": _number(raw, 12, 4, "little"), "asbits": 16}
    if raw[:5] == b"\x7fFLAC" and len(raw) >= 35:
        bits = _number(raw, 27, 8)
        return {"type": "audio", "codec": "flac", "anch": (bits >> 41) % 8 + 1, "arate": bits >> 44, "asbits": (bits >> 36) % 32 + 1}
    if raw[:8] == b"Speex   " and len(raw) >= 52:
        return {"type": "audio", "codec": "speex", "anch": _number(raw, 48, 4, "little"), "arate": _number(raw, 36, 4, "little"), "asbits": 16}
    if raw[:7] == b"\x80theora" and len(raw) >= 20:
        return {"type": "video", "codec": "theora", "width": _number(raw, 14, 3), "height": _number(raw, 17, 3)}
    return None


def ogg(data) -> dict:
    """A track for each stream, from the pages that begin one; these stand before all others."""
    tracks, at = [], 0
    while data[at : at + 4] == b"OggS" and len(tracks) < MOST:
        segments = data[at + 27 : at + 27 + _number(data, at + 26, 1)]
        start, size = at + 27 + len(segments), sum(segments)
        if not _number(data, at + 5, 1) & 2:
            break
        track = _audio_packet(data[start : start + min(size, 64)])
        if track:
            tracks.append(track)
        at = start + size
    if not at:
        raise ValueError("no page")
    return _tracked("ogg", tracks)


# Codecs of Flash video by number.
FLASH_VIDEO = {2: "h263", 3: "screen", 4: "vp6", 5: "vp6alpha", 6: "screen2", 7: "h264"}
FLASH_AUDIO = {0: "pcm", 1: "adpcm", 2: "mp3", 3: "pcm", 4: "nellymoser", 5: "nellymoser", 6: "nellymoser", 7: "alaw", 8: "mulaw", 10: "aac", 11: "speex", 14: "mp3"}


def flv(data) -> dict:
    """The first audio and the first video tag; sizes of H.263 frames are in the frame's first bits."""
    flags = _number(data, 4, 1)
    audio, video = ({"type": "audio"} if flags & 4 else None), ({"type": "video"} if flags & 1 else None)
    at, waiting = 13, {8: audio, 9: video}
    while any(t is not None and "codec" not in t for t in waiting.values()) and at + 12 <= len(data):
        kind, size = _number(data, at, 1) & 31, _number(data, at + 1, 3)
        track, head = waiting.get(kind), _number(data, at + 11, 1)
        if track is not None and "codec" not in track and size:
            if kind == 8:
                track |= {"codec": FLASH_AUDIO.get(head >> 4, str(head >> 4)), "anch": 1 + (head & 1), "arate": (5512, 11025, 22050, 44100)[head >> 2 & 3], "asbits": 16 if head & 2 else 8}
            else:
                track["codec"] = FLASH_VIDEO.get(head & 15, str(head & 15))
                raw = data[at + 12 : at + 28]
                if track["codec"] == "h263" and len(raw) >= 9:
                    bits = int.from_bytes(raw, "big") << 30 & (1 << 8 * len(raw)) - 1  # after the start code, version and reference
                    form, left = bits >> 8 * len(raw) - 3, 8 * len(raw) - 3
                    fixed = {2: (352, 288), 3: (176, 144), 4: (128, 96), 5: (320, 240), 6: (160, 120)}
                    if form in (0, 1):
                        width = 8 << form
                        track |= {"width": bits >> left - width & (1 << width) - 1, "height": bits >> left - 2 * width & (1 << width) - 1}
                    elif form in fixed:
                        track["width"], track["height"] = fixed[form]
        at += 15 + size
    return _tracked("flv", [t for t in (audio, video) if t is not None])


def webp(data) -> dict:
    """Dimensions from the first chunk: of the canvas, the lossy or the lossless frame."""
    kind = data[12:16]
    if kind == b"VP8X":
        return {"format": "webp", "subformat": "extended", "width": _number(data, 24, 3, "little") + 1, "height": _number(data, 27, 3, "little") + 1}
    if kind == b"VP8L":
        bits = _number(data, 21, 4, "little")
        if data[20:21] != b"/" or bits >> 29:
            raise ValueError("bad lossless header")
        return {"format": "webp", "codec": "webp-lossless", "width": bits % (1 << 14) + 1, "height": (bits >> 14) % (1 << 14) + 1}
    return vp8(data[20:30]) | {"format": "webp"}


def vp8(data) -> dict:
    """The key frame's dimensions."""
    if data[3:6] != b"\x9d\x01*":
        raise ValueError("no start code")
    width, height = (_number(data, at, 2, "little") % (1 << 14) for at in (6, 8))
    if not width or not height:
        raise ValueError("no dimensions")
    return {"format": "vp8", "codec": "vp8", "width": width, "height": height}


def _icons(kind: str):
    def walk(data) -> dict:
        """The largest image of the directory; a tie goes to the one stored last in the order of width, height and place."""
        count = _number(data, 4, 2, "little")
        if not 1 <= count <= 64:
            raise ValueError("bad count")
        best = (0, 0, 0, 0)
        for k in range(count):
            width, height, _, reserved, planes, bits, size, place = struct.unpack("<BBBBHHII", data[6 + 16 * k : 22 + 16 * k])
            width, height = width or 256, height or 256
            if reserved not in (0, 1, 255) or not size or place < 6 + 16 * count:
                raise ValueError("bad entry")
            if (planes > 4 or bits not in (0, 1, 2, 4, 8, 16, 24, 32)) if kind == "ico" else (planes >= width or bits >= height):
                raise ValueError("bad entry")
            best = max(best, (width * height, width, height, place))
        out = {"format": kind, "width": best[1], "height": best[2]}
        if kind == "ico":
            head = data[best[3] : best[3] + 20]
            if head[:4] == b"\x89PNG" and head[12:16] == b"IHDR":
                out |= {"subformat": "png", "codec": "flate"}
            elif len(head) == 20:
                number = _number(head, 16, 4, "little")
                out |= {"subformat": "bmp", "codec": {0: "uncompressed", 1: "rle", 2: "rle", 3: "bitfields"}.get(number, str(number))}
        return out

    return walk


def adts(data) -> dict:
    """Sampling of the first frame of AAC, or of MPEG audio of layers 1 to 3."""
    head = _number(data, 0, 4)
    if head >> 16 in (0xFFF0, 0xFFF1, 0xFFF8, 0xFFF9):
        # Sampling rates by index.
        rates = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
        index, channels = head >> 10 & 15, head >> 6 & 7
        if index >= len(rates):
            raise ValueError("bad rate")
        track = {"type": "audio", "codec": "aac", "arate": rates[index], "asbits": 16}
        return {"format": "aac", "tracks": [track | ({"anch": channels + (channels == 7)} if channels else {})]}
    layer, rate = 4 - (head >> 17 & 3), head >> 10 & 3
    if head >> 21 != 0x7FF or layer == 4 or rate == 3 or head >> 12 & 15 in (0, 15):
        raise ValueError("no frame")
    # Sampling rates of MPEG 1; versions 2 and 2.5 have a half and a quarter.
    arate = (44100, 48000, 32000)[rate] >> {3: 0, 2: 1, 0: 2}.get(head >> 19 & 3, 0)
    codec = f"mp{layer}"
    return {"format": "mp3" if layer == 3 else "mpeg-adts", "tracks": [{"type": "audio", "codec": codec, "arate": arate, "anch": 1 if head >> 6 & 3 == 3 else 2, "asbits": 16}]}


def ac3(data) -> dict:
    head = data[:7]
    if len(head) < 7 or head[4] >= 192:
        raise ValueError("no frame")
    # Sampling rates and channels by number.
    return {"format": "ac3", "tracks": [{"type": "audio", "codec": "ac3", "arate": (48000, 44100, 32000)[head[4] >> 6], "anch": (2, 1, 2, 3, 3, 4, 4, 5)[head[6] >> 5], "asbits": 16}]}


def id3(data) -> dict:
    """What stands after the tag: FLAC, or MPEG audio."""
    from fathomline.analyzers.walkers import flac

    size = sum((data[6 + k] & 127) << 7 * (3 - k) for k in range(4))
    at = 10 + size + (10 if data[5] & 16 else 0)
    end = min(len(data), at + (1 << 16))
    while at < end and data[at] == 0:
        at += 1
    rest = data[at : at + 26]
    if rest[:4] == b"fLaC":
        return flac(rest)
    return adts(rest) if len(rest) >= 4 else {"format": "id3v2"}


WALKERS = {"mov": mov, "mkv": mkv, "avi": avi, "ogg": ogg, "flv": flv, "webp": webp, "vp8": vp8, "ico": _icons("ico"), "cur": _icons("cur"), "mpeg-adts": adts, "ac3": ac3, "id3v2": id3}
