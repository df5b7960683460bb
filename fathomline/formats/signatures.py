"""Format signatures: what leading bytes a format has, and how sure a match makes us.

A signature is a chain of conditions on the header, `@offset 'bytes'` or `@offset in{'bytes','bytes'}` with
alternatives of one length; `@offset in[x-y]` is a range of bytes. All must hold. A fixed condition of n bytes adds 100 n to the confidence; one
with alternatives adds 12.5 times the binary logarithm of their number, rounded down, less than that; either
loses 10 for each byte (10 at most) between it and the condition before it. A guarded signature also asks
for values of single bytes.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cache

from fathomline.formats.further import FURTHER, RULED

#: Bytes of a file that signatures look at.
HEADER_BYTES = 512
#: Files of fewer than four bytes are named by their length.
BY_LENGTH = ("empty", "short1", "short2", "short3")
BY_LENGTH_CONFIDENCE = 100_000
UNKNOWN = "?"

# Format, class and signature.
SIGNATURES = r"""
7z archive @0 '7z\xbc\xaf\x27\x1c'
ace archive @4 '\x00' @7 '**ACE**'
ar archive @0 '!<arch>\x0a'
cab archive @0 'MSCF\x00\x00\x00\x00'
cpio archive @0 in{'070707','070701','070702'}
cpio archive @0 in{'q\xc7','\xc7q'}
deb archive @0 '!<arch>\x0adebian-binary '
rar archive @0 'Rar!'
rpm archive @0 '\xed\xab\xee\xdb'
stuffit archive @0 'SIT!' @10 'rLau'
stuffit archive @0 'StuffIt (c)1997'
stuffitx archive @0 'StuffIt' @7 in{'!','?'}
wad archive @0 in{'IWAD','PWAD'}
zip archive @0 'PK' @2 in{'\x01\x02','\x03\x04','\x05\x06','\x07\x08','\x06\x06'}
aac audio @0 'ADIF'
aifc audio @0 'FORM' @8 'AIFC' @12 in{'FVER','COMM'} @16 '\x00\x00\x00'
aiff audio @0 'FORM' @8 'AIFFCOMM\x00\x00\x00\x12'
ape audio @0 'MAC '
flac audio @0 'fLaC'
midi audio @0 'MThd\x00\x00\x00\x06\x00\x00\x00\x01'
midi audio @0 'MThd\x00\x00\x00\x06\x00' @9 in{'\x00','\x01','\x02'} @10 in{'\x00','\x01','\x02','\x03'}
midi-rmid audio @0 'RIFF' @8 'RMIDdata' @20 'MThd\x00\x00\x00\x06\x00' @29 in{'\x00','\x01','\x02'}
oggpcm audio @0 'PCM     \x00\x00\x00'
ralf audio @0 'LSD:' @4 in{'\x01','\x02','\x03'}
realaudio audio @0 '.ra\xfd'
speex audio @0 'Speex   1.'
erlang-beam code @0 'FOR1' @8 'BEAM'
erlang-beam code @0 '\x7fBEAM!'
llvm-bitcode code @0 '\xde\xc0\x17\x0b\x00\x00\x00\x00'
llvm-bitcode code @0 'BC\xc0\xde'
ruby-yarv code @0 'YARB' @4 in{'\x01','\x02','\x03','\x04'} @5 '\x00\x00\x00'
scratch code @0 in{'ScratchV01','ScratchV02'}
solidity code @0 'pragma solidity '
solidity code @0 'contract '
wasm code @0 '\x00asm\x01\x00\x00\x00'
wasm code @0 '(module' @7 in{'\x09','\x0a','\x0b','\x0c','\x0d',' '}
brotli compress @0 '\xce\xb2\xcf\x81'
bz2 compress @0 'BZh'
bzip compress @0 'BZ0'
compress compress @0 '\x1f\x9d'
flate compress @0 'x' @1 in{'\x01','^','\x9c','\xda'}
gz compress @0 '\x1f\x8b\x08'
lrzip compress @0 'LRZI'
lz4 compress @0 '\x04"M\x18'
lz4-legacy compress @0 '\x04"M\x18'
lzip compress @0 'LZIP'
lzma compress @0 ']\x00\x00' @12 in{'\x00','\xff'}
lzop compress @0 '\x89LZO\x00\x0d\x0a\x1a\x0a'
lzx compress @0 'LZX'
mozlz4 compress @0 'mozLz40\x00'
msdos-compress-szdd compress @0 'SZDD\x88\xf0\x273'
mszip compress @0 'CK'
pack compress @0 '\x1f\x1e'
rzip compress @0 'RZIP'
xz compress @0 '\xfd7zXZ\x00'
zstd compress @0 in{'%\xb5/\xfd','(\xb5/\xfd'}
zstd-dict compress @0 '7\xa40\xec'
age-encrypted crypto @0 'age-encryption.org/v1\x0a'
openssl-symmetric-encrypted crypto @0 'Salted__'
pkcs7-signature crypto @0 '0\x80\x06\x09*\x86H\x86\xf7\x0d\x01\x07\x02'
signify crypto @0 'untrusted comment: '
ssh-public-keys crypto @0 'ssh-rsa '
ssh-public-keys crypto @0 'ssh-dss '
ssh-public-keys crypto @0 'ssh-ed25519 '
arrow-feather database @0 'FEA1'
arrow-ipc database @0 'ARROW1\x00\x00'
hdf4 database @0 '\x0e\x03\x13\x01' @10 '\x00\x1e\x00\x01'
hdf4 database @0 '\x0e\x03\x13\x01'
hdf5 database @0 '\x89HDF\x0d\x0a\x1a\x0a' @8 in{'\x00','\x01','2'}
msoffice-accdb database @0 '\x00\x01\x00\x00Standard ACE DB\x00' @22 '\x00\x00'
msoffice-mdb database @0 '\x00\x01\x00\x00Standard Jet DB\x00' @22 '\x00\x00'
parquet database @0 'PAR1'
sqlite3-journal database @0 '\xd9\xd5\x05\xf9 \xa1c\xd7'
sqlite3-shm database @0 '\x00-\xe2\x18\x00\x00\x00\x00' @12 '\x00\x00\x00\x01'
sqlite3-shm database @0 '\x18\xe2-\x00\x00\x00\x00\x00' @12 '\x01\x00\x00\x00'
dvi doc @0 '\xf7' @1 in{'\x02','\x03'} @2 '\x01\x83\x92\xc0\x1c;\x00\x00'
fig doc @0 '#FIG ' @5 in{'1','2','3'} @6 '.'
pdf doc @0 '%PDF-1.'
perl-pod doc @0 '=pod' @4 in{' ','\x0a'}
perl-pod doc @0 in{'=head1 ','=begin '}
ps doc @0 '%!PS-Adobe-' @11 in{'1','2','3'} @12 '.'
ps doc @0 '%!PS' @4 in{'\x0a','\x0d'} @5 '%%BoundingBox: '
ps doc @0 '%!PS\x0d\x0a%%BoundingBox: '
smil doc @0 '<smil' @5 in{'\x09','\x0a','\x0b','\x0c','\x0d',' ','>'}
svg doc @0 '<svg' @4 in{'\x09','\x0a','\x0b','\x0c','\x0d',' ','>'}
svg doc @0 '<svg:svg' @8 in{'\x09','\x0a','\x0b','\x0c','\x0d',' ','>'}
texinfo doc @0 '\input texinfo' @14 in{'\x0d','\x0a',' ','\x09'}
texinfo doc @0 '@ignore' @7 in{'\x0d','\x0a',' ','\x09'}
texinfo doc @0 '@comment' @8 in{'\x0d','\x0a',' ','\x09'}
wri doc @0 in{'1\xbe\x00\x00','2\xbe\x00\x00'} @4 '\x00\xab\x00\x00\x00\x00\x00\x00\x00'
afm font @0 'StartFontMetrics ' @17 in{'1','2','3','4'} @18 '.'
bdf font @0 'STARTFONT 2.' @12 in{'1','2'}
pfa font @0 '%!PS-AdobeFont-1.' @17 in{'0','1'} @18 ': '
alias-pix image @4 '\x00\x00\x00\x00\x00' @9 in{'\x08','\x18'}
art image @0 'JG' @2 in{'\x03','\x04'} @3 '\x0e\x00\x00\x00'
cineon image @0 '\x80*_\xd7\x00\x00'
cineon image @0 '\xd7_*\x80' @6 '\x00\x00'
cmuwm image @0 in{'\xf1\x00@\xbb','\xbb@\x00\xf1'}
dds image @0 'DDS \x7c\x00\x00\x00' @76 ' \x00\x00\x00'
djvu image @0 'AT&TFORM' @12 'DJV' @15 in{'U','M'}
farbfeld image @0 'farbfeld'
fbm image @0 '%bitmap\x00'
fif image @0 'FIF\x01'
fuji-raf image @0 'FUJIFILMCCD-RAW 020' @19 in{'0','1'} @20 'FF383501'
gif image @0 'GIF8' @4 in{'7a','9a'}
jbig2 image @0 '\x97JB2\x0d\x0a\x1a\x0a'
jbig2 image @0 '\x00\x00\x00\x000\x00\x01\x00\x00\x00\x13' @19 '\x00\x00\x00\x00\x00\x00\x00\x00'
jng image @0 '\x8bJNG\x0d\x0a\x1a\x0a\x00\x00\x00'
jpeg image @0 '\xff\xd8\xff\xe0'
jpeg image @0 '\xff\xd8\xff\xe1'
jpeg image @0 '\xff\xd8\xff\xdb'
jpegxl image @0 '\xff\x0a'
jpegxl-brunsli image @0 '\x0a\x04B\xd2\xd5N'
lepton image @0 '\xcf\x84' @2 in{'\x01','\x02'} @3 in{'X','Y','Z'}
macpaint image @0 '\x00\x00\x00' @3 in{'\x02','\x03'} @4 in{'\x00\x00\x00\x00\x00\x00\x00\x00','\xff\xff\xff\xff\xff\xff\xff\xff'}
miff image @0 'id=ImageMagick'
mng image @0 '\x8aMNG\x0d\x0a\x1a\x0a'
pds image @0 'NJPL1I00PDS'
pds image @0 'PDS_VERSION_ID' @14 in{'\x09','\x0a','\x0b','\x0c','\x0d',' '}
pds image @0 'CCSD3ZF'
pik image @0 in{'P\xccK\x0a','\xd7LM\x0a'}
png image @0 '\x89PNG\x0d\x0a\x1a\x0a\x00\x00\x00' @12 'IHDR'
png image @0 '\x89PNG\x0d\x0a\x1a\x0a\x00\x00\x00\x04CgBIP\x00 ' @24 '\x00\x00\x00' @28 'IHDR'
pnot image @0 '\x00\x00\x00\x14pnot' @12 '\x00\x00'
psd image @0 '8BPS' @4 in{'\x00\x01','\x00\x02'} @6 '\x00\x00\x00\x00\x00\x00'
qtif image @0 in{'\x00','\x01'} @4 in{'idat','iicc'}
qtif image @0 '\x00\x00\x00' @4 'idsc'
tiff image @0 in{'MM\x00*','II*\x00'}
xloadimage-niff image @0 'NIFF\x00\x00\x00\x01'
xpm image @0 '! XPM2' @6 in{'\x0d','\x0a'}
xpm image @0 '/* XPM */' @9 in{'\x0d','\x0a'}
ybm image @0 '!!'
amv media @0 'RIFF' @8 'AMV LIST' @20 'hdrlamvh8\x00\x00\x00'
ani media @0 'RIFF' @8 'ACON' @12 in{'LIST','anih','seq ','rate'}
asf media @0 '0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel'
avi media @0 'RIFF' @8 'AVI '
dv media @0 '\x1f\x07\x00'
dvd-video-video-ts-ifo media @0 'DVDVIDEO-VMG\x00'
dvd-video-vts-ifo media @0 'DVDVIDEO-VTS\x00'
flv media @0 'FLV\x01' @5 '\x00\x00\x00\x09\x00\x00\x00\x00'
ivf media @0 'DKIF\x00\x00 \x00'
mkv media @0 '\x1aE\xdf\xa3'
mov media @4 'mdat'
mpeg-cdxa media @0 'RIFF' @8 'CDXAfmt ' @17 '\x00\x00\x00'
mpeg-ps media @0 '\x00\x00\x01\xba'
ogg media @0 'OggS\x00\x02' @18 '\x00\x00\x00\x00' @26 '\x01'
cue other @0 'REM GENRE '
cue other @0 'REM DATE '
cue other @0 'REM DISCID '
desktop other @0 '[Desktop Entry]' @15 in{'\x0d','\x0a'}
desktop other @0 '[KDE Desktop Entry]' @19 in{'\x0d','\x0a'}
desktopini other @0 '[.ShellClassInfo]' @17 in{'\x0d','\x0a'}
desktopini other @0 '[LocalizedFileNames]' @20 in{'\x0d','\x0a'}
desktopini other @0 '[ViewState]' @11 in{'\x0d','\x0a'}
dsstore other @0 '\x00\x00\x00\x01Bud1\x00'
lnk other @0 'L\x00\x00\x00\x01\x14\x02\x00\x00\x00\x00\x00\xc0\x00\x00\x00\x00\x00\x00F'
m3u-extended other @0 '#EXTM3U' @7 in{'\x0d','\x0a'}
olecf other @0 in{'\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1','\x0e\x11\xfc\x0d\xd0\xcf\x11\x0e'}
ppd other @0 '*PPD-Adobe: "'
ppd other @0 '*PPD-Adobe:  "'
ppd other @0 '*Product: "'
url other @0 '[InternetShortcut]' @18 in{'\x0d','\x0a'}
utf16 other @0 in{'\xff\xfe','\xfe\xff'}
utf8 other @0 '\xef\xbb\xbf'
vcalendar-ics other @0 'BEGIN:VCALENDAR' @15 in{'\x0d','\x0a'}
vcard-vcf other @0 'BEGIN:VCARD' @11 in{'\x0d','\x0a'}
yaml other @0 in{'---\x0a','---\x0d','--- '}
emf vector @0 '\x01\x00\x00\x00' @5 '\x00\x00\x00' @40 ' EMF\x00\x00\x01\x00' @58 '\x00\x00'
wmf vector @0 '\xd7\xcd\xc6\x9a\x00\x00'
wmf vector @0 in{'\x01\x00\x09\x00\x00','\x02\x00\x09\x00\x00'} @5 in{'\x01','\x03'} @16 '\x00\x00'
flic video @4 in{'\x12\xaf','\x11\xaf'} @12 '\x08\x00' @14 in{'\x03\x00','\x00\x00'}
yuv4mpeg2 video @0 'YUV4MPEG2 '
"""


@dataclass(frozen=True)
class Condition:
    offset: int
    options: tuple[bytes, ...]

    @property
    def size(self) -> int:
        return len(self.options[0])


@dataclass(frozen=True)
class Signature:
    """guards are conditions on single bytes that add nothing to the confidence by themselves; together they add bonus."""

    format: str
    kind: str
    conditions: tuple[Condition, ...]
    guards: tuple[Condition, ...] = ()
    bonus: int = 0

    @property
    def confidence(self) -> int:
        total, end = self.bonus, 0
        for c in self.conditions:
            total += 100 * c.size - 10 * min(c.offset - end, 10) - math.floor(12.5 * math.log2(len(c.options)))
            end = c.offset + c.size
        return total

    def matches(self, header: bytes) -> bool:
        return all(header[c.offset : c.offset + c.size] in c.options for c in self.conditions + self.guards)


_TEXT = r"'((?:[^'\\]|\\.)*)'"
_BYTE = r"(?:\\x[0-9a-f]{2}|[^\\])"
_CONDITION = re.compile(rf" @(\d+) (?:{_TEXT}|in\{{({_TEXT}(?:,{_TEXT})*)\}}|in\[({_BYTE}(?:-{_BYTE})?(?:,{_BYTE}(?:-{_BYTE})?)*)\])", re.DOTALL)


def _bytes(text: str) -> bytes:
    return re.sub(r"\\x([0-9a-f]{2})|\\(['\\])", lambda m: chr(int(m[1], 16)) if m[1] else m[2], text).encode("latin-1")


def _ranges(text: str) -> list[bytes]:
    """The single bytes of ranges x-y and bytes x, parted by commas."""
    found = re.findall(rf"({_BYTE})(?:-({_BYTE}))?(?:,|$)", text)
    return [bytes([b]) for x, y in found for b in range(_bytes(x)[0], _bytes(y or x)[0] + 1)]


def parsed(line: str) -> Signature:
    name, kind, rest = line.split(" ", 2)
    rest, conditions, at = " " + rest, [], 0
    while at < len(rest):
        m = _CONDITION.match(rest, at)
        if not m:
            raise ValueError(f"bad signature: {line!r}")
        if m.group(6) is not None:
            options = tuple(_ranges(m.group(6)))
        else:
            options = tuple(_bytes(x) for x in ([m[2]] if m[3] is None else re.findall(_TEXT, m[3])))
        if len({len(x) for x in options}) != 1:
            raise ValueError(f"alternatives of unlike length: {line!r}")
        conditions.append(Condition(int(m[1]), options))
        at = m.end()
    return Signature(name, kind, tuple(conditions))


def _letters(text: str) -> list[tuple[int, bytes]]:
    return [(i, (c.lower() + c.upper()).encode()) for i, c in enumerate(text)]


# Signatures with values that single bytes may have, and what these add to the confidence.
GUARDED = (
    (r"au audio @0 '.snd\x00\x00\x00' @12 '\x00\x00\x00'", [(15, (1, 2, 3, 4, 5, 6, 7, 23, 24, 25, 26, 27)), (20, b"\0"), (21, b"\0"), (22, b"\0"), (23, range(1, 16))], 368),
    (r"bmp image @0 'BM' @6 '\x00\x00\x00\x00' @15 '\x00\x00\x00'", [(14, range(12, 128)), (21, range(256))], 52),
    (r"id3v2 audio @0 'ID3'", [(3, range(10)), (5, range(0, 256, 8)), (6, range(128)), (7, range(128)), (8, range(128)), (9, range(128))], 100),
    (r"java-class code @0 '\xca\xfe\xba\xbe' @6 '\x00'", [(7, range(30, 256))], 1),
    (r"mov media @0 '\x00\x00\x00' @4 'ftyp' @8 in{'qt  ','f4v ','isom','mp41','mp42','jp2 ','jpm ','jpx '}", [(3, range(16, 256, 4))], 26),
    (r"mov media @0 '\x00\x00\x00' @4 'ftyp'", [(3, range(16, 256, 4))], 26),
    (r"mov media @0 '\x00\x00\x00' @4 'ftypmif1'", [(3, range(16, 256, 4))], 26),
    (r"realmedia media @0 '.RMF\x00\x00\x00'", [(7, range(8, 256))], 2),
    (r"unixscript code @0 '#!'", [(2, b"/")], 110),
    (r"unixscript code @0 '#!'", [(2, b" "), (3, b"/")], 110),
    (r"wav audio @0 'RIFF' @8 in{'WAVE','RMP3'} @12 in{'fmt ','bext','JUNK'}", [(12, b"f"), (16, range(16, 81)), (17, b"\0"), (18, b"\0"), (19, b"\0")], 315),
    (r"wav audio @0 'RIFF' @8 in{'WAVE','RMP3'} @12 in{'fmt ','bext','JUNK'}", [(12, b"bJ")], 1),
    (r"windows-cmd code @0 '@' @1 in{'e','E'}", [*_letters("@echo off")[1:], (9, b"\r"), (10, b"\n")], 900),
)


@cache
def signatures() -> tuple[Signature, ...]:
    plain = tuple(parsed(x) for x in (SIGNATURES.strip() + FURTHER.rstrip()).split("\n"))
    guarded = ((parsed(line), guards, bonus) for line, guards, bonus in GUARDED)
    return plain + tuple(Signature(s.format, s.kind, s.conditions, tuple(Condition(at, tuple(bytes([b]) for b in options)) for at, options in guards), bonus) for s, guards, bonus in guarded)


@cache
def ruled() -> tuple[tuple[Signature, str, int | str], ...]:
    """Signatures with a condition, SQL over the header h, and what it adds to the confidence."""
    return tuple((parsed(line), rule, bonus) for line, rule, bonus in RULED)


@cache
def formats() -> dict[str, str]:
    """Class by format, for all formats that detection can name."""
    return {s.format: s.kind for s in (*signatures(), *(s for s, _, _ in ruled()))} | dict.fromkeys(BY_LENGTH, "other") | {"html": "other", "pnm": "image"}
