"""Metadata records from the text of `ls -l` listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ENTRY = r"^-\S*\s+([0-9]+)\s+\S+\s+\S+\s+([0-9]+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$"


def ls_records(lines: DataFrame, listing: str = "listing", order: str = "line_no", text: str = "line", year: int | None = None) -> DataFrame:
    """listing, line_no, f, size, mtime of the regular files of listings; lines are ordered inside each listing.

    A directory's header line (`dir:`) holds until the next one; leading `./` go. Times are read in the
    session's time zone, except with --full-time, whose own zone counts. `year NNNN` lines, or the argument,
    give the year of entries that show a time of day instead. Entries with a bad date are dropped.
    """
    line = F.regexp_replace(F.col(text), "\n$", "")
    header = F.when(line.rlike(":$") & ~line.rlike("^-"), F.regexp_replace(F.regexp_replace(F.regexp_replace(line, ":$", ""), "^/+|/+$", ""), "^(?:\\./+)+", ""))
    said = F.when(line.rlike(r"^year\s+[0-9]{4}$"), F.regexp_extract(line, "([0-9]{4})", 1).cast("int"))
    so_far = Window.partitionBy(listing).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumns({"dir": F.last(header, ignorenulls=True).over(so_far), "year": F.coalesce(F.last(said, ignorenulls=True).over(so_far), F.lit(year).cast("int"))}).where(line.rlike(ENTRY))
    part = lambda k: F.regexp_extract(line, ENTRY, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(3))
    day = F.lpad(part(4), 2, "0")
    clock = F.when(part(5).rlike("^[0-9]{4}$"), F.concat(part(5), F.lit("-"), month, F.lit("-"), day, F.lit(" 00:00")))
    clock = clock.when(part(5).rlike("^[0-9]{1,2}:[0-9]{2}$"), F.concat(F.col("year"), F.lit("-"), month, F.lit("-"), day, F.lit(" "), F.lpad(part(5), 5, "0")))
    short = F.unix_timestamp(F.try_to_timestamp(clock, F.lit("yyyy-M-dd HH:mm")))
    full = F.regexp_extract(F.concat_ws(" ", part(3), part(4)), r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", 0)
    zone = F.regexp_extract(part(5), r"^([+-][0-9]{2})([0-9]{2})$", 1)
    zoned = F.unix_timestamp(F.try_to_timestamp(F.concat(full, zone, F.lit(":"), F.substring(part(5), 4, 2)), F.lit("yyyy-MM-dd HH:mm:ssXXX")))
    name = F.when(F.coalesce("dir", F.lit(".")).isin("", "."), part(6)).otherwise(F.concat("dir", F.lit("/"), part(6)))
    return rows.select(listing, order, name.alias("f"), part(2).cast("long").alias("size"), F.when(month > 0, short).otherwise(zoned).alias("mtime")).where("mtime is not null")
