"""Text functions of the interchange format, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_encode(value: Column) -> Column:
    """Encodes the four bytes that a value of an info line can't hold: per cent, NUL, line feed and space."""
    for raw, code in (("%", "%25"), ("\0", "%00"), ("\n", "%0A"), (" ", "%20")):
        value = F.replace(value, F.lit(raw), F.lit(code))
    return value


def percent_decode(value: Column) -> Column:
    """Decodes each `%hh`; a per cent sign without two hexadecimal digits stays. The bytes are read as UTF-8."""
    # One value of parts and codes for all uses: a lambda would split the text anew for each code.
    found = F.struct(F.split(value, "%[0-9a-fA-F]{2}", -1).alias("parts"), F.regexp_extract_all(value, F.lit("%([0-9a-fA-F]{2})"), F.lit(1)).alias("codes"))

    def joined(v: Column) -> Column:
        pieces = F.transform(v["parts"], lambda p: F.hex(F.encode(p, "UTF-8")))
        return F.array_join(F.transform(F.arrays_zip(F.concat(F.array(F.lit("")), v["codes"]).alias("c"), pieces.alias("p")), lambda x: F.concat(x["c"], x["p"])), "")

    decoded = F.get(F.transform(F.array(found), lambda v: F.decode(F.unhex(joined(v)), "UTF-8")), F.lit(0))
    return F.when(F.instr(value, "%") == 0, value).otherwise(decoded)


def number_text(value: Column) -> Column:
    """A double as the interchange format has it: integral values below 1e15 without a fraction."""
    whole = (F.abs(value) < 1e15) & (F.floor(value) == value)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
