"""Scans of files: listing, comparison with an earlier snapshot, detection, parameters, and info lines."""

from __future__ import annotations

import errno
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.analyzers.layouts import parameters
from fathomline.analyzers.walkers import WALKERS, walked
from fathomline.operators.detect import detect
from fathomline.operators.snapshots import is_thumbnail, with_change
from fathomline.sources import listing
from fathomline.sources.info_lines import format_line

#: Leading bytes for detection and fixed layouts, and for walkers of files that are shorter; of others they read and seek in the file.
ANALYZED_BYTES = 65536
PARAMETERS = ["width", "height", "codec", "subformat", "vcodec", "acodec", "anch", "arate", "asbits", "error"]


#: The extended attribute that holds a file's tags.
TAGS = "user.mmfs.tags"


def _found(spark: SparkSession, paths: list[str]) -> DataFrame:
    listing.register(spark)
    return spark.read.format("file_listing").option("paths", json.dumps(list(paths))).option("headerBytes", 0).load()


def listed(spark: SparkSession, paths: list[str], thumbnails: bool = True, before: int | None = None, tags: bool = False) -> DataFrame:
    """f, size, mtime, symlink, is_symlink and tags of all files under paths; no file is opened.

    before leaves out files of that time (in seconds) or later, which may still be written to. tags reads them
    from the extended attribute TAGS: '' for a file without it, null where attributes can't be read.
    """
    rows = _found(spark, paths).where("error is null")
    rows = rows if thumbnails else rows.where(~is_thumbnail(F.col("path")))
    rows = rows if before is None else rows.where(F.col("mtime") < before)
    rows = rows.select(F.col("path").alias("f"), "size", "mtime", "symlink", (F.col("kind") == "symlink").alias("is_symlink"), F.lit(None).cast("string").alias("tags"))
    return rows.mapInArrow(_tagged, rows.schema) if tags else rows


def _tagged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        found: list[str | None] = []
        for name, link in zip(batch.column("f").to_pylist(), batch.column("is_symlink").to_pylist()):
            try:
                found.append("" if link else os.getxattr(name, TAGS).decode("utf-8", "replace"))
            except OSError as e:
                found.append("" if e.errno in (errno.ENODATA, errno.EOPNOTSUPP) else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=batch.schema.names)


def diagnostics(spark: SparkSession, paths: list[str], records: DataFrame | None = None) -> DataFrame:
    """f and error of what a scan of paths passes over: directories that can't be listed, files that can't be looked at, and, of records with all their errors (scan's with errors=True), those that have one."""
    rows = _found(spark, paths).where("error is not null").select(F.col("path").alias("f"), "error")
    return rows if records is None else rows.unionByName(records.where("error is not null").select("f", "error"))


def _read(it: Iterator[pa.RecordBatch], hashed: bool, limit: int) -> Iterator[pa.RecordBatch]:
    """Adds each file's leading bytes and, if asked, its digest, in one reading."""
    for batch in it:
        contents, digests, errors = [], [], []
        for name, link in zip(batch.column("f").to_pylist(), batch.column("is_symlink").to_pylist()):
            content = digest = error = None
            if not link:
                try:
                    with open(name, "rb") as f:
                        content = f.read(limit)
                        if hashed:
                            state = hashlib.sha256(content)
                            while piece := f.read(1 << 20):
                                state.update(piece)
                            digest = state.hexdigest()
                except OSError:
                    error = "bad_open" if content is None else "bad_read_sha256"
            contents.append(content)
            digests.append(digest)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents, pa.binary()), pa.array(digests, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "content", "sha256", "read_error"])


def analyzed(files: DataFrame, content: str = "content", name: str | None = None, limit: int = 0) -> DataFrame:
    """files with format and PARAMETERS, in one pass: column expressions where the layout is fixed, else walkers; name and limit as walked() has them."""
    found = parameters(detect(files, content), content)
    fixed = [c for c in PARAMETERS if c != "subformat"]
    found = found.withColumnsRenamed({c: f"fixed_{c}" for c in fixed}).withColumn("detected", F.col("format"))
    walks = walked(found, content, name, limit)
    by_walker = F.col("detected").isin(*WALKERS)
    chosen = {c: F.when(by_walker, F.col(c) if c in walks.columns else F.lit(None)).otherwise(F.col(f"fixed_{c}")) for c in fixed}
    return walks.withColumns(chosen).drop("detected", "confidence", *(f"fixed_{c}" for c in fixed))


def scan(
    spark: SparkSession, paths: list[str], old: DataFrame | None = None, sha256: bool = True, thumbnails: bool = True, before: int | None = None, tags: bool = False, mtime: bool = True, errors: bool = False
) -> DataFrame:
    """One record for each file under paths that is new or changed since the snapshot old (f, size, mtime, tags, symlink, is_symlink).

    Unchanged files are not opened: the comparison comes before the reading; mtime and tags say whether these count
    as changes (tags if they are read). before and tags as listed() has them. Records with an error other than
    bad_data or bad_read_sha256 are left out, as a scan's output is the next scan's snapshot, unless errors
    asks for them; diagnostics() tells of them.
    """
    files = listed(spark, paths, thumbnails, before, tags)
    if old is not None:
        files = with_change(files, old, mtime=mtime, tags=tags).where("changed").drop("changed")
    files = files.repartition("f")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in files.schema.fields)}, content binary, sha256 string, read_error string"
    found = analyzed(files.mapInArrow(lambda it: _read(it, sha256, ANALYZED_BYTES), schema), name="f", limit=ANALYZED_BYTES)
    found = found.withColumn("error", F.coalesce("read_error", "error")).withColumn("format", F.when(F.col("is_symlink"), "symlink").otherwise(F.col("format")))
    found = found.drop("content", "read_error")
    return found if errors else found.where("error is null or error in ('bad_data', 'bad_read_sha256')")


def info_lines(records: DataFrame) -> DataFrame:
    """Records of scan() as lines (value) of the interchange format."""
    fields = {c: F.col(c).cast("string") for c in ("size", "mtime", "sha256", "symlink", "tags", *PARAMETERS) if c in records.columns}
    return records.select(format_line(fields, F.col("f"), F.col("format")).alias("value"))
