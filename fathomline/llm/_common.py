"""Helpers shared by the training-data operators: tables, scratch tables, row functions over Arrow batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Separators of the contracts' words `[^\x20\x09-\x0D]+`; bytes.split() without arguments splits at the same six bytes.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where a session of one machine names none (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        root = tempfile.mkdtemp(prefix="fathomline-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors.

    The files go when the session's file system is closed, that is, when the driver ends, or earlier by dropped().
    Once it is written nothing reads the shuffles before it again; Spark deletes them when the driver's garbage is
    collected, which is asked for here, as it may otherwise take so long that all shuffles of a job are on disk together.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    spark._jvm.System.gc()
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that saved() made and that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores appended as make it unlike all columns (Spark tells no upper from lower case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fraction_hash(column: str = "doc_id"):
    """crc32 of an id as text, by which the contracts hold documents out."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def batches(function: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow from one that turns a batch into a batch; empty batches pass unseen."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield function(batch)

    return run


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The values of a string column as UTF-8 bytes, null as empty, without making Python strings."""
    view = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    for x in view:
        yield x.as_py() or b""


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *added: StructField) -> DataFrame:
    """df.mapInArrow() of a function that appends columns, also where own columns have names that Spark would take apart at a dot."""
    plain = [c if c.replace("_", "").isalnum() else unused(df.columns, f"own_{i}_")[0] for i, c in enumerate(df.columns)]
    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(plain, df.schema.fields)), *added])
    return df.toDF(*plain).mapInArrow(function, schema).toDF(*df.columns, *(f.name for f in added))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
