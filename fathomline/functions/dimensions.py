"""Reasonable ranges of media parameters, and lengths with units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges outside which a header is taken for bad data.
DIMENSION_RANGE = (16, 16383)
CHANNEL_RANGE = (1, 15)
RATE_RANGE = (1000, 1_000_000)
SAMPLE_SIZES = (8, 12, 16, 20, 24, 32, 48, 64)
# Pixels of a unit in SVG.
SVG_UNITS = {"px": 1.0, "pt": 1.25, "pc": 15.0, "mm": 3.543307, "cm": 35.43307, "in": 90.0}


def plausible_dimensions(width: Column, height: Column) -> Column:
    return width.between(*DIMENSION_RANGE) & height.between(*DIMENSION_RANGE)


def plausible_audio(channels: Column, rate: Column, sample_size: Column) -> Column:
    return channels.between(*CHANNEL_RANGE) & rate.between(*RATE_RANGE) & sample_size.isin(*SAMPLE_SIZES)


def svg_length(text: Column) -> Column:
    """Pixels of a length such as `2.5mm`, rounded half up; null for anything that is no non-negative length."""
    clean = F.regexp_replace(F.lower(text), r"^[\t-\r ]+|[\t-\r ]+$", "")
    unit = F.regexp_extract(clean, r"(px|pt|pc|mm|cm|in)$", 1)
    number = F.regexp_replace(F.regexp_replace(clean, r"(px|pt|pc|mm|cm|in)$", ""), r"[\t-\r ]+$", "")
    factor = F.lit(1.0)
    for name, pixels in SVG_UNITS.items():
        factor = F.when(unit == name, F.lit(pixels)).otherwise(factor)
    value = F.expr("try_cast(null as double)")
    value = F.when(number.rlike(r"^(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?$") & number.rlike("[0-9]$"), number.try_cast("double")).otherwise(value)
    return F.floor(value * factor + 0.5).cast("long")
