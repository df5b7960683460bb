"""The line-oriented metadata interchange format: `format=… key=value … f=name`, one record a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import percent_decode, percent_encode


def format_line(fields: dict[str, Column], name: Column, kind: Column) -> Column:
    """A line of string columns: format first, other non-null fields by key in byte order, the name last and as it is.

    A missing or empty format is `?`. A name with a line feed or NUL raises.
    """
    parts = [F.concat(F.lit("format="), percent_encode(F.when(F.coalesce(kind, F.lit("")) == "", F.lit("?")).otherwise(kind)))]
    parts += [F.when(fields[k].isNotNull(), F.concat(F.lit(f"{k}="), percent_encode(fields[k]))) for k in sorted(fields, key=str.encode)]
    bad = F.contains(name, F.lit("\n")) | F.contains(name, F.lit("\0"))
    return F.concat_ws(" ", *parts, F.when(name.isNotNull(), F.concat(F.lit("f="), F.when(bad, F.raise_error(F.lit("bad byte in file name"))).otherwise(name))))


def parsed_lines(lines: DataFrame, column: str = "value", decode: bool = True) -> DataFrame:
    """f, fields (map of the other keys) and error of each line.

    The first ` f=` begins the name, which reaches to the end and is never decoded. error is null or says
    why a line is bad: no name, an item without `=`, or a key that is there twice (`f` included); fields is
    null then.
    """
    line = F.regexp_replace(F.col(column), "\n$", "")
    at = F.instr(line, " f=")
    head = F.when(at > 0, F.substring(line, F.lit(1), at - 1))
    items = F.split(head, " ", -1)
    keys = F.transform(items, lambda x: F.substring_index(x, "=", 1))
    values = F.transform(items, lambda x: F.substring(x, F.instr(x, "=") + 1, F.length(x)))
    values = F.transform(values, percent_decode) if decode else values
    error = (
        F.when(at == 0, "f= not found")
        .when(F.exists(items, lambda x: F.instr(x, "=") == 0), "item without =")
        .when((F.size(F.array_distinct(keys)) < F.size(keys)) | F.array_contains(keys, "f"), "duplicate key")
    )
    return lines.withColumn("error", error).select(
        "*", F.when(at > 0, F.substring(line, at + 3, F.length(line))).alias("f"), F.when(F.col("error").isNull(), F.map_from_arrays(keys, values)).alias("fields")
    )


def read_info_lines(spark: SparkSession, path: str, decode: bool = True) -> DataFrame:
    """Lines of text files, split at line feeds only: carriage returns belong to the data."""
    return parsed_lines(spark.read.option("lineSep", "\n").text(path), decode=decode)


def snapshot(parsed: DataFrame, order: str) -> DataFrame:
    """f, size, mtime, tags, symlink, is_symlink of an earlier scan: of lines of one name the last by `order`. Rows without an integer size are passed over; unknown tags are null, a symlink's are empty."""
    get = lambda k: F.try_element_at("fields", F.lit(k))
    rows = parsed.where("error is null").select(
        "f", order, F.trim(get("size")).try_cast("long").alias("size"), get("mtime").try_cast("long").alias("mtime"),
        F.coalesce(get("tags"), F.when(get("format") == "symlink", "")).alias("tags"), get("symlink").alias("symlink"), F.coalesce(get("format") == "symlink", F.lit(False)).alias("is_symlink"),
    ).where("size is not null")
    values = F.struct("size", "mtime", "tags", "symlink", "is_symlink")
    return rows.groupBy("f").agg(F.max_by(values, order).alias("v")).select("f", "v.*")
