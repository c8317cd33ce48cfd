"""Helpers that the training-data operators share: words, hashes, shared-folder tables."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A word, for Java's and DuckDB's regex engines; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that executors and driver share, which spark.checkpoint.dir names; without it an error, but in local mode a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="lociweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: lineage ends there, and lost executors cost nothing.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lociweave/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables whose dependants are all materialised themselves; nothing for other frames."""
    for df in tables:
        if hasattr(df, "shared_path"):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shared_path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let go of finished shuffles: Spark drops their files when the driver's garbage goes, which may be much later than their last use."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """What is materialised inside goes to Python in batches of so many rows, for columns of large values."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fold(column: str = "text") -> Column:
    """The text with A-Z alone in lower case; null counts as empty."""
    return F.translate(F.coalesce(F.col(column), F.lit("")), UPPER, LOWER)


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo: the fold of a row."""
    return F.crc32(F.col(column).cast("string")) % modulus


def whole_ids(docs: DataFrame) -> None:
    """Raise a TypeError unless doc_id has an integer type."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id is {kind.simpleString()}; an integer type is needed")


def numbered(docs: DataFrame, **more: Column) -> DataFrame:
    """(row, rid, and what `more` names): the rows of docs, each as a struct, with a number that stays, as a table in the shared folder."""
    return materialise(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid"), *(c.alias(k) for k, c in more.items())), "numbered")
