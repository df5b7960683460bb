"""Merging of metadata records that describe one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _conflicts(keys: list[str]) -> Column:
    """Names of the columns that have two or more unlike values in a group, in order."""
    return F.array_compact(F.array(*(F.when(F.size(f"kinds_{k}") > 1, F.lit(k)) for k in keys)))


def _merged(rows: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.collect_set(k).alias(f"kinds_{k}") for k in keys), F.min(F.col("mtime").cast("long")).cast("string").alias("least_mtime"))
    found = found.withColumn("unlike", _conflicts(keys))
    only = F.col("unlike") == F.array(F.lit("mtime"))
    conflicts = F.when(only, F.array().cast("array<string>")).otherwise(F.col("unlike")).alias("conflicts")
    return found.select(*by, "n", conflicts, *(F.when(only & F.lit(k == "mtime"), F.col("least_mtime")).otherwise(F.get(f"kinds_{k}", F.lit(0))).alias(k) for k in keys))


def merge_records(rows: DataFrame, keys: list[str], name: str = "f") -> DataFrame:
    """(f, *keys, n, conflicts): the union of each file's records, for string columns keys, `mtime` among them.

    Null is an absent key. If only mtime differs the smallest counts. conflicts has the keys with unlike values,
    whose value here is any of them. The sets are of unlike values of one key of one file.
    """
    return _merged(rows, [name], keys).select(name, *keys, "n", "conflicts")


def merge_by(rows: DataFrame, keys: list[str], name: str = "f") -> DataFrame:
    """The merge's output records (f, *keys): one for a file without conflict; else, on a conflict of size, or of sha256, one for each value of it whose group has no conflict; and all the others as they were."""
    first = merge_records(rows, keys, name)
    clean = first.where(F.size("conflicts") == 0).select(name, *keys)
    by = F.when(F.array_contains("conflicts", "size"), F.lit("size")).when(F.array_contains("conflicts", "sha256"), F.lit("sha256"))
    hard = first.where(F.size("conflicts") > 0).select(name, by.alias("split_by"))
    left = rows.select(name, *keys).join(hard, name).withColumn("split_value", F.when(F.col("split_by") == "size", F.col("size").cast("long").cast("string")).when(F.col("split_by") == "sha256", F.col("sha256")))
    groups = _merged(left.where("split_by is not null"), [name, "split_value"], keys)
    again = groups.where(F.size("conflicts") == 0).select(name, *keys)
    bad = groups.where(F.size("conflicts") > 0).select(F.col(name).alias("bad_name"), F.col("split_value").alias("bad_value"))
    same = (F.col(name) == F.col("bad_name")) & F.col("split_value").eqNullSafe(F.col("bad_value"))
    kept = left.where("split_by is not null").join(bad, same, "left_semi").select(name, *keys)
    return clean.unionByName(again).unionByName(kept).unionByName(left.where("split_by is null").select(name, *keys))
