"""Incremental scans: what changed since an earlier snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _unlike(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def with_change(listing: DataFrame, old: DataFrame, mtime: bool = True, tags: bool = False) -> DataFrame:
    """listing (f, size, mtime, symlink, is_symlink, tags) with changed: not in old, or of another size, link or kind, or, if asked, another time or other tags.

    Unknown (null) differs from any value and equals unknown. The join comes before any file is opened, so
    that unchanged files never are.
    """
    before = old.select(F.col("f").alias("old_f"), *(F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "tags", "symlink", "is_symlink")))
    changed = F.col("old_f").isNull() | _unlike("size", "old_size") | _unlike("symlink", "old_symlink") | _unlike("is_symlink", "old_is_symlink")
    if mtime:
        changed = changed | _unlike("mtime", "old_mtime")
    if tags:
        changed = changed | _unlike("tags", "old_tags")
    joined = listing.join(before, F.col("f") == F.col("old_f"), "left").withColumn("changed", changed)
    return joined.select(*listing.columns, "changed")


def is_thumbnail(path: Column) -> Column:
    return F.endswith(path, F.lit(".th.jpg")) | F.endswith(path, F.lit(".th.jpg.tmp"))


def settled(files: DataFrame, now: int, seconds: int, mtime: str = "mtime") -> DataFrame:
    """Files that were last changed more than so many seconds before now."""
    return files.where(F.col(mtime) + seconds < now)


def scan_order(path: Column) -> Column:
    """A sort key that puts a directory's files before its directories, each by name, depth first."""
    parts = F.split(path, "/")
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), p)), "\x01")
