"""Media parameters of formats whose headers have a fixed layout, as column expressions over the header's bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.dimensions import CHANNEL_RANGE, DIMENSION_RANGE, RATE_RANGE


@dataclass(frozen=True)
class Number:
    """An unsigned integer of size bytes at an offset."""

    at: int
    size: int
    little: bool = False

    def of(self, header: Column) -> Column:
        piece = F.substring(header, self.at + 1, self.size)
        text = F.hex(piece)
        if self.little:
            text = F.concat(*(F.substring(text, 2 * k + 1, 2) for k in reversed(range(self.size))))
        return F.when(F.length(piece) == self.size, F.conv(text, 16, 10).cast("long"))


def big(at: int, size: int) -> Number:
    return Number(at, size)


def little(at: int, size: int) -> Number:
    return Number(at, size, True)


@dataclass(frozen=True)
class Layout:
    """width and height (plus `extra`, for windows given by their corners), codec by name or by a number, audio parameters, and checks. ranged: video whose dimensions have to be reasonable."""

    least: int
    width: Number | None = None
    height: Number | None = None
    low: tuple[Number, Number] | None = None
    codec: str | None = None
    codec_at: Number | None = None
    codecs: tuple[tuple[int, str], ...] = ()
    channels: Number | None = None
    rate: Number | None = None
    sample_size: int | Number | None = None
    kind: str = "image"
    ranged: bool = False
    checks: tuple[tuple[Number, int, int], ...] = ()


# Where formats keep what.
LAYOUTS = {
    "amv": Layout(32, little(64, 4), little(68, 4), codec="mjpeg", kind="video"),
    "dds": Layout(88, little(16, 4), little(12, 4), codec="uncompressed", checks=((little(4, 4), 124, 124), (little(76, 4), 32, 32))),
    "farbfeld": Layout(8, big(8, 4), big(12, 4), codec="uncompressed"),
    "fit": Layout(16, big(4, 4), big(8, 4), checks=((big(12, 4), 1, 32),)),
    "flic": Layout(16, little(8, 2), little(10, 2), codec="rle", kind="video", ranged=True),
    "gif": Layout(10, little(6, 2), little(8, 2), codec="lzw"),
    "ivf": Layout(8, little(12, 2), little(14, 2), codec_at=little(8, 4), codecs=((0x30385056, "vp8"), (0x30395056, "vp9"), (0x31305641, "av1"), (0x34363248, "h264")), kind="video"),
    "jng": Layout(24, big(16, 4), big(20, 4), codec="jpeg"),
    "mng": Layout(24, big(16, 4), big(20, 4), codec="jpeg+png", kind="video", ranged=True),
    "pcx": Layout(12, little(8, 2), little(10, 2), low=(little(4, 2), little(6, 2)), codec_at=big(2, 1), codecs=((0, "uncompressed"), (1, "rle"))),
    "png": Layout(24, big(16, 4), big(20, 4), codec="flate"),
    "psd": Layout(26, big(18, 4), big(14, 4), checks=((big(12, 2), 1, 56), (big(24, 2), 0, 15))),
    "ras": Layout(4, big(4, 4), big(8, 4), codec_at=big(20, 4), codecs=((0, "uncompressed"), (1, "uncompressed"), (2, "rle"))),
    "sgi-rgb": Layout(12, big(6, 2), big(8, 2), codec_at=big(2, 1), codecs=((0, "uncompressed"), (1, "rle")), checks=((big(2, 1), 0, 1), (big(3, 1), 1, 2), (big(4, 2), 1, 3))),
    "opus": Layout(16, codec="opus", channels=big(9, 1), rate=little(12, 4), sample_size=16, kind="audio", checks=((big(8, 1), 1, 15),)),
    "vorbis": Layout(16, codec="vorbis", channels=big(11, 1), rate=little(12, 4), sample_size=16, kind="audio", checks=((little(7, 4), 0, 0),)),
    "gz": Layout(3, codec="flate"),
    "flate": Layout(2, codec="flate"),
    "xz": Layout(6, codec="lzma"),
}


def _values(layout: Layout, h: Column) -> Column:
    number = lambda n: F.lit(None).cast("long") if n is None else F.lit(n).cast("long") if isinstance(n, int) else n.of(h)
    width, height = number(layout.width), number(layout.height)
    if layout.low:
        width, height = width - number(layout.low[0]) + 1, height - number(layout.low[1]) + 1
    codec = F.lit(layout.codec).cast("string")
    for value, name in layout.codecs:
        codec = F.when(number(layout.codec_at) == value, name).otherwise(codec)
    bad = F.length(h) < layout.least
    for n, low, high in layout.checks:
        bad = bad | ~F.coalesce(number(n).between(low, high), F.lit(False))
    if layout.low:
        bad = bad | (width < 1) | (height < 1)
    if layout.ranged:
        bad = bad | ~(F.coalesce(width, F.lit(16)).between(*DIMENSION_RANGE) & F.coalesce(height, F.lit(16)).between(*DIMENSION_RANGE))
    if layout.kind == "audio":
        bad = bad | ~F.coalesce(number(layout.channels).between(*CHANNEL_RANGE) & number(layout.rate).between(*RATE_RANGE), F.lit(False))
    audio, video = layout.kind == "audio", layout.kind == "video"
    none = F.lit(None).cast("string")
    return F.struct(
        width.alias("width"), height.alias("height"), (none if audio or video else codec).alias("codec"), (codec if video else none).alias("vcodec"), (codec if audio else none).alias("acodec"),
        number(layout.channels).alias("anch"), number(layout.rate).alias("arate"), number(layout.sample_size).alias("asbits"), F.when(bad, "bad_data").alias("error"),
    )


def parameters(files: DataFrame, content: str = "content") -> DataFrame:
    """files (with format, as detect() gives it) with width, height, codec, vcodec, acodec, anch, arate, asbits and error appended.

    error is bad_data where a header is too short or a value is out of range; what was read stays beside it.
    Formats without a fixed layout, and null contents, have nulls.
    """
    header = F.col(content)
    out = None
    for name, layout in LAYOUTS.items():
        case = F.col("format") == name
        out = F.when(case, _values(layout, header)) if out is None else out.when(case, _values(layout, header))
    # In a lambda, as the chain of cases is beyond the size of a compiled method.
    values = F.get(F.transform(F.array(F.struct(F.col("format"), header)), lambda _: out), F.lit(0))
    names = ["width", "height", "codec", "vcodec", "acodec", "anch", "arate", "asbits", "error"]
    return files.drop(*names).withColumn("parameters", values).select("*", "parameters.*").drop("parameters")
